"""Lines joined to blocks, and the headers above each block.

Whether a line goes on the one before depends on whether that one did, a recurrence: join = A or (join before and B).
Solved, a line joins if the last row where A holds is not before the last where B doesn't, both up to here. So blocks
need two running maxima over one window, by document in line order, and no fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import spaced_letters
from ..functions.segment import fix_spaced_characters
from ..functions.strings import connected
from .features import with_features
from .lines import exploded

_LEADING = "�\\*,.?•➢ƒ–'\"—"


def clean_lines(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", xml: bool = False, words: list[str] | None = None) -> DataFrame:
    """keys, block_idx, block_text, block_type, header_block_idx of every block of every text (a text of no lines: none).

    header_block_idx is the last header block so far (a header's own), -1 if there is none; as in the reference
    behaviour, the last block does not count as a header for itself, and loses a bullet before it. With words (by
    frequency), lines written letter by letter are read as words first, but for XML.
    """
    lines = exploded(docs, keys, text, xml)
    if words and not xml:
        lines = lines.withColumn("line", F.when(spaced_letters(F.col("line")), fix_spaced_characters(F.col("line"), words)).otherwise(F.col("line")))
    columns = ["line_no", "text", "line_type", "incomplete_line", "continuing_line", "ends_with_period", "is_list_or_row"]
    return join_lines(with_features(lines).select(*keys, *columns), keys)


def join_lines(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks of lines with features; one shuffle by keys, shared by all windows and the grouping."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = ~(F.col("is_list_or_row") | (F.col("line_type") == "list_item"))
    before = lambda name: F.coalesce(F.lag(name).over(order), F.lit(False))
    first = F.lag("line_no").over(order).isNull()
    flagged = lines.withColumn("__a", ~first & (F.col("continuing_line") | (before("incomplete_line") & free))).withColumn("__b", ~first & ~before("ends_with_period") & free)
    last_a = F.max(F.when(F.col("__a"), F.col("line_no"))).over(so_far)
    last_not_b = F.max(F.when(~F.col("__b"), F.col("line_no"))).over(so_far)
    joined = flagged.withColumn("__join", last_a.isNotNull() & (last_a >= last_not_b))
    numbered = joined.withColumn("block_idx", (F.sum(F.when(F.col("__join"), 0).otherwise(1)).over(so_far) - 1).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "text", "line_type")))
    grouped = numbered.groupBy(*keys, "block_idx").agg(parts.alias("p")).select(*keys, "block_idx", connected(F.col("p.text")).alias("block_text"), F.element_at("p.line_type", 1).alias("first"), F.size("p").alias("n"))
    typed = grouped.select(*keys, "block_idx", "block_text", F.when((F.col("n") > 1) & (F.col("first") != "list_item"), "para").otherwise(F.col("first")).alias("block_type"))
    blocks = Window.partitionBy(*keys).orderBy("block_idx")
    is_last = F.lead("block_idx").over(blocks).isNull()
    header = F.last(F.when((F.col("block_type") == "header") & ~F.col("__last"), F.col("block_idx")), ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bullet = F.col("__last") & (F.col("block_type") == "list_item") & F.lit(_LEADING).contains(F.substring("block_text", 1, 1))
    text = F.when(bullet, F.regexp_replace(F.expr("substring(block_text, 2)"), r"(?U)^\s+", "")).otherwise(F.col("block_text"))
    return typed.withColumn("__last", is_last).select(*keys, "block_idx", text.alias("block_text"), "block_type", F.coalesce(header, F.lit(-1)).alias("header_block_idx"))


def with_headers(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks that have text, with the index and text of the last header up to each (its own for a header); -1 and '' before any."""
    so_far = Window.partitionBy(*keys).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_header = F.col("block_type") == "header"
    at = F.last(F.when(is_header, F.struct("block_idx", "block_text")), ignorenulls=True).over(so_far)
    out = blocks.filter(F.col("block_text") != "").withColumn("__h", at)
    return out.withColumn("header_block_idx", F.coalesce("__h.block_idx", F.lit(-1))).withColumn("header_text", F.coalesce("__h.block_text", F.lit(""))).drop("__h")


def titles(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), length: int = 50) -> DataFrame:
    """keys and title: the first block's text, cut with an ellipsis."""
    first = blocks.groupBy(*keys).agg(F.min_by("block_text", "block_idx").alias("t"))
    return first.select(*keys, F.when(F.length("t") > length, F.concat(F.substring("t", 1, length), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def level_chain(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), levels: Sequence[int] | None = None) -> DataFrame:
    """Blocks (keys, block_idx, block_type, block_text, level) with level_chain: the headers above, nearest first, without the block itself.

    For each level, the last header of that level counts if it is also the last of that or any smaller level.
    Conditional running maxima; no stack. The levels are those that headers have, found by an aggregation unless given.
    """
    w = Window.partitionBy(*keys).orderBy("block_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_header = F.col("block_type") == "header"
    if levels is None:  # a row a level
        levels = sorted(r["level"] for r in blocks.filter(is_header & F.col("level").isNotNull()).select("level").distinct().collect())
    out = blocks
    for k in levels:
        out = out.withColumn(f"__at{k}", F.last(F.when(is_header & (F.col("level") == k), F.struct("block_idx", "block_text")), ignorenulls=True).over(so_far))
        out = out.withColumn(f"__to{k}", F.max(F.when(is_header & (F.col("level") <= k), F.col("block_idx"))).over(so_far))
    found = [F.when(F.col(f"__at{k}.block_idx") == F.col(f"__to{k}"), F.col(f"__at{k}")) for k in reversed(levels)]
    none = F.filter(F.array(F.struct("block_idx", "block_text")), lambda x: F.lit(False))
    chain = F.filter(F.array(*found), lambda x: x.isNotNull() & ~(is_header & (x["block_idx"] == F.col("block_idx")))) if found else none
    return out.withColumn("level_chain", chain).drop(*(f"__{n}{k}" for n in ("at", "to") for k in levels))


def page_blocks(blocks: DataFrame, types: Sequence[str] = ("list_item", "para", "numbered_list_item", "header")) -> DataFrame:
    """Only blocks that have running text."""
    return blocks.filter(F.col("block_type").isin(*types))


def balanced(text: Column) -> Column:
    """Whether a text has as many opening as closing round brackets."""
    return F.length(F.translate(text, "(", "")) == F.length(F.translate(text, ")", ""))
