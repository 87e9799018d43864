"""Files as bytes: texts are decoded, everything else goes to an extractor that gives HTML.

Extraction from PDF and Office bytes is a service outside of this library. An extractor is a function of (content, mime,
options) that runs in the workers; by default that is the Tika client, if it is installed there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[bytes, str, dict], str]

# Request headers of the extraction service, without and with character recognition; seconds that it may take.
TIMEOUT = 3000
PLAIN = {"X-Tika-OCRskipOcr": "true", "X-Tika-PDFOcrStrategy": "auto", "X-Tika-PDFExtractFontNames": "true"}
OCR = {
    "X-Tika-OCRskipOcr": "false",
    "X-Tika-OCRoutputType": "hocr",
    "X-Tika-Timeout-Millis": str(100 * TIMEOUT),
    "X-Tika-PDFOcrStrategy": "ocr_only",
    "X-Tika-OCRtimeoutSeconds": str(TIMEOUT),
}
TEXTS = ("text/plain", "text/html", "text/markdown", "text/x-markdown", "text/xml", "application/xml")


def by_service(content: bytes, mime: str, options: dict) -> str:
    """HTML of a file by the extraction service."""
    try:
        from tika import parser
    except ImportError as missing:
        raise RuntimeError(f"no extractor for {mime}: install the Tika client or give one") from missing
    return parser.from_buffer(content, xmlContent=True, requestOptions=options)["content"] or ""


def was_extracted(html: Column) -> Column:
    """Whether a page's head says that it comes from the extraction service."""
    return F.regexp_extract(F.lower(html), "(?s)<head.*?</head>", 0).contains("org.apache.tika.parser")


def extracted(files: DataFrame, ocr: bool = False, extractor: Extractor = by_service) -> DataFrame:
    """Files (doc_id, mime, content) as documents (doc_id, mime, text): texts decoded as UTF-8, others as the extractor's HTML.

    Bytes that are no UTF-8 are replaced; a null content is an empty text. Only files that aren't texts reach Python.
    """
    options = {"headers": OCR if ocr else PLAIN, "timeout": TIMEOUT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [extractor(content or b"", mime or "", options) for mime, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["text/html"] * len(said), pa.string()), pa.array(said, pa.string())], names=["doc_id", "mime", "text"])

    is_text = F.coalesce(F.col("mime").isin(*TEXTS), F.lit(False))
    texts = files.filter(is_text).select("doc_id", "mime", F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit("")).alias("text"))
    kind = files.schema["doc_id"].dataType.simpleString()
    return texts.unionByName(files.filter(~is_text).select("doc_id", "mime", "content").mapInArrow(run, f"doc_id {kind}, mime string, text string"))
