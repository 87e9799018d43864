"""Documents of mixed kinds, each parsed by its mime type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, render
from . import html, markdown, xml
from .binary import extracted


def text_blocks(docs: DataFrame) -> DataFrame:
    return blocks.with_headers(blocks.clean_lines(docs)).withColumn("level", F.lit(0))


def _html(docs: DataFrame) -> DataFrame:
    return html.html_blocks(docs.withColumnRenamed("text", "html"), "doc_id")


def _markdown(docs: DataFrame) -> DataFrame:
    return markdown.markdown_blocks(docs).withColumn("block_idx", F.col("part")).drop("part", "table_idx")


#: Parsers by mime type; anything else counts as HTML that was extracted before.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"text/plain": text_blocks, "text/html": _html, "text/markdown": _markdown, "text/x-markdown": _markdown, "text/xml": xml.xml_blocks, "application/xml": xml.xml_blocks}


# Types by the endings of names; other names are plain text.
MIMES = {"md": "text/markdown", "markdown": "text/markdown", "xml": "text/xml", "htm": "text/html", "html": "text/html", "xhtml": "text/html", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword"}


def mime_of(name: str) -> str:
    return MIMES.get(name.rsplit(".", 1)[-1].lower() if "." in name else "", "text/plain")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as documents: doc_id (the path), mime (by its ending) and text; files that aren't texts by the extraction service."""
    files = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in MIMES.items() for x in pair))
    return extracted(files.select(F.col("path").alias("doc_id"), F.coalesce(F.try_element_at(known, ending), F.lit("text/plain")).alias("mime"), "content"))


def parse(docs: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, mime, text): one branch a parser over the rows of its types, put together by column names."""
    by_parser: dict[Callable, list[str]] = {}
    for mime, parser in PARSERS.items():
        by_parser.setdefault(parser, []).append(mime)
    known = [m for m in PARSERS if PARSERS[m] is not _html]
    branches = []
    for parser, mimes in by_parser.items():
        rows = docs.filter(F.col("mime").isin(mimes) if parser is not _html else ~F.coalesce(F.col("mime").isin(known), F.lit(False)))
        branches.append(parser(rows.select("doc_id", "text")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def parse_document(docs: DataFrame, render_format: str = "all") -> DataFrame:
    """doc_id with json, html or (all) both of each document."""
    made = parse(docs)
    if render_format == "json":
        return render.render_json(made, envelope=True)
    if render_format == "html":
        return render.render_html(made)
    return render.render_json(made, envelope=True).join(render.render_html(made), "doc_id")
