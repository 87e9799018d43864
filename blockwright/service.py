"""A small HTTP service over one session: GET / tells that it runs, POST /api/parseDocument parses a file.

The parameters are those of sources.dispatch.parse_document: renderFormat (all, json, html) and mime, by default from the
file's name. The body is the file, as it is or as the first part of a form.
"""

from __future__ import annotations

import json
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from .sources.binary import extracted
from .sources.dispatch import mime_of, parse_document

PORT = 5001
FORMATS = ("all", "json", "html")


def health(spark: SparkSession) -> DataFrame:
    """One row that says the session works."""
    return spark.range(1).selectExpr("'Service is running' AS status", "200 AS code")


def parsed(spark: SparkSession, name: str, content: bytes, render_format: str = "all", mime: str | None = None, ocr: bool = False) -> dict:
    """A file's reply: status and return_dict, or an error with its reason."""
    if render_format not in FORMATS:
        return {"status": "fail", "reason": f"unknown format {render_format}"}
    try:
        files = spark.createDataFrame([(name, mime or mime_of(name), bytearray(content))], "doc_id string, mime string, content binary")
        row = parse_document(extracted(files, ocr), render_format).first()
    except Exception as error:  # the reply tells what went wrong, the service goes on
        return {"status": "fail", "reason": str(error).splitlines()[0]}
    return {"status": "ok", "return_dict": {k: json.loads(v) if k == "json" else v for k, v in row.asDict().items() if k != "doc_id"} if row else {}}


def first_file(body: bytes, content_type: str) -> tuple[str, bytes]:
    """The name and content of a form's first file; a body that is no form is the file itself."""
    if "multipart/form-data" not in content_type:
        return "document.txt", body
    form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    part = next(p for p in form.iter_parts() if p.get_filename())
    return part.get_filename(), part.get_payload(decode=True)


def server(spark: SparkSession, port: int = PORT) -> ThreadingHTTPServer:
    """The service, bound to its port; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, said: dict, code: int = 200) -> None:
            body = json.dumps(said).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            row = health(spark).first()
            self.reply({"status": row.status}, row.code) if urlparse(self.path).path == "/" else self.reply({"status": "fail"}, 404)

        def do_POST(self) -> None:
            url = urlparse(self.path)
            if url.path != "/api/parseDocument":
                return self.reply({"status": "fail"}, 404)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}
            name, content = first_file(self.rfile.read(int(self.headers.get("Content-Length", 0))), self.headers.get("Content-Type", ""))
            said = parsed(spark, name, content, asked.get("renderFormat", "all"), asked.get("mime"), asked.get("applyOcr", "no") == "yes")
            self.reply(said, 200 if said["status"] == "ok" else 500)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("0.0.0.0", port), Handler)


def main() -> None:
    spark = SparkSession.builder.appName("blockwright").getOrCreate()
    with server(spark) as running:
        running.serve_forever()


if __name__ == "__main__":
    main()
