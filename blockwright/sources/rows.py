"""Rows of tables as documents: a title, and below it a header and blocks for every column."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.blocks import clean_lines


def read_rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A CSV file with a header line; empty fields become N/A."""
    return spark.read.csv(path, header=True, **options).na.fill("N/A")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each XLSX file, with the names in its first row; all columns are strings, empty cells N/A.

    Files are read by Spark and opened in workers, one at a time; their sheets must have the same names.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    names = sheet_rows(bytes(files.first()["content"]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                body = [[*row, *[""] * len(names)][: len(names)] for row in sheet_rows(content)[1:]]
                columns = list(zip(*body, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array([v or "N/A" for v in c], pa.string()) for c in columns], names=names)

    return files.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


# Namespaces of workbooks.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as texts, by their places; cells that aren't there are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        inside = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in inside:
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = ElementTree.fromstring(book.read(min((n for n in inside if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))))
    rows = []
    for row in sheet.iter(f"{_MAIN}row"):
        cells: dict[int, str] = {}
        for cell in row.iter(f"{_MAIN}c"):
            column = 0
            for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                column = column * 26 + ord(letter) - 64
            value = cell.find(f"{_MAIN}v")
            text = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            cells[column - 1 if column else len(cells)] = shared[int(text)] if cell.get("t") == "s" else text
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def row_documents(rows: DataFrame, key: str, title_range: Sequence[int] = (1, 2), columns: Sequence[str] | None = None) -> DataFrame:
    """key, block_idx, block_type, block_text, level and header_text of each row: title (level 0, of the columns in the 1-based range), column headers (1), values (2).

    A value of one block is a paragraph; one whose lines are all too short is an empty paragraph. Ranges outside the
    columns fall back to the first two.
    """
    names = list(columns or rows.columns)
    first, last = (title_range[0] - 1, title_range[-1]) if 1 <= title_range[0] <= title_range[-1] <= len(names) else (0, 2)
    said = [F.coalesce(F.col(n).cast("string"), F.lit("N/A")) for n in names]
    title = F.concat_ws(" ", *said[first:last])
    cells = F.posexplode(F.array(*(F.struct(F.lit(n.replace("_", " ")).alias("header_text"), v.alias("text")) for n, v in zip(names, said, strict=True)))).alias("col", "c")
    long = rows.select(F.col(key).alias("__key"), cells).select("__key", "col", "c.header_text", "c.text")
    found = clean_lines(long, keys=("__key", "col", "header_text"))
    every = long.select("__key", "col", "header_text").join(found, ["__key", "col", "header_text"], "left")
    single = F.count("*").over(Window.partitionBy("__key", "col")) == 1
    body = every.select("__key", "col", F.coalesce("block_idx", F.lit(0)).alias("sub"), F.when(single, "para").otherwise(F.col("block_type")).alias("block_type"), F.coalesce("block_text", F.lit("")).alias("block_text"), F.lit(2).alias("level"), "header_text")
    heads = long.select("__key", "col", F.lit(-1).alias("sub"), F.lit("header").alias("block_type"), F.col("header_text").alias("block_text"), F.lit(1).alias("level"), "header_text")
    tops = rows.select(F.col(key).alias("__key"), F.lit(-1).alias("col"), F.lit(-1).alias("sub"), F.lit("header").alias("block_type"), title.alias("block_text"), F.lit(0).alias("level"), title.alias("header_text"))
    order = Window.partitionBy("__key").orderBy("col", "sub")
    out = tops.unionByName(heads).unionByName(body).withColumn("block_idx", (F.row_number().over(order) - 1).cast("int"))
    return out.select(F.col("__key").alias(key), "block_idx", "block_type", "block_text", "level", "header_text")
