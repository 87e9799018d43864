"""XML documents to blocks: elements give headers, the text of leaves gives blocks below them."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.blocks import clean_lines

NODE = "ord int, level int, header string, text string"


def readable(tag: str) -> str:
    """snake_case and CamelCase to Title Case; a lower-case word capitalised."""
    if "_" in tag:
        return " ".join(tag.split("_")).title()
    if tag.islower():
        return tag.capitalize()
    return " ".join(re.findall(r"[A-Z](?:[a-z]+|[A-Z]*(?=[A-Z]|$))", tag)).title()


def nodes(document: str | None) -> list[tuple[int, str | None, str | None]]:
    """(level, header, text) of each element in order; header null for a textblock, text null for an inner element.

    An element without text is left out with all below it; a textblock is a level up, as are its later siblings.
    Documents that are no XML have no nodes.
    """
    try:
        root = ET.fromstring(document or "")
    except ET.ParseError:
        return []
    found: list[tuple[int, str | None, str | None]] = []

    def walk(parent: ET.Element, level: int) -> None:
        for child in parent:
            if not child.text:
                continue
            header = " ".join(filter(None, [readable(child.tag), " ".join(child.attrib.values())]))
            if len(child):
                found.append((level, header, None))
                walk(child, level + 1)
            elif child.tag == "textblock":
                level -= 1
                found.append((level, None, child.text))
            else:
                found.append((level, header, child.text))

    walk(root, 0)
    return found


def xml_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block_idx, block_type, block_text, level and header_text of each block of each XML text.

    A leaf's blocks stand one level below its header; after a header among them, paragraphs stand two below and have it
    as header_text. A leaf with one block gives a paragraph.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, k, *n) for i, t in enumerate(batch.column(1).to_pylist()) for k, n in enumerate(nodes(t))]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            owner, *columns = (pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [()] * 5, types, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], names=[key, "ord", "level", "header", "text"])

    found = docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, {NODE}")
    by_doc = Window.partitionBy(key).orderBy("ord")
    found = found.withColumn("above", F.last("header", ignorenulls=True).over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    headers = found.filter("header is not null").select(key, "ord", F.lit(-1).alias("sub"), F.lit("header").alias("block_type"), F.col("header").alias("block_text"), "level", F.col("header").alias("header_text"))
    leaves = found.filter("text is not null")
    said = clean_lines(leaves, keys=(key, "ord", "level", "above"), xml=True)
    leaf = Window.partitionBy(key, "ord").orderBy("block_idx")
    single = F.count("*").over(Window.partitionBy(key, "ord")) == 1
    said = said.withColumn("block_type", F.when(single, "para").otherwise(F.col("block_type")))
    inner = F.last(F.when(F.col("block_type") == "header", F.col("block_text")), ignorenulls=True).over(leaf.rowsBetween(Window.unboundedPreceding, -1))
    said = said.withColumn("inner", inner)
    below = F.col("inner").isNotNull() & (F.col("block_type") == "para")
    body = said.select(key, "ord", F.col("block_idx").alias("sub"), "block_type", "block_text", (F.col("level") + F.when(below, 2).otherwise(1)).alias("level"), F.when(below, F.col("inner")).otherwise(F.coalesce("above", F.lit(""))).alias("header_text"))
    order = Window.partitionBy(key).orderBy("ord", "sub")
    return headers.unionByName(body).withColumn("block_idx", (F.row_number().over(order) - 1).cast("int")).select(key, "block_idx", "block_type", "block_text", "level", "header_text")
