"""Lines and blocks of whole pages: what is kept of ignored lines, where stray blocks belong, which page has a word; and the chain from lines to blocks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import spaced_capitals
from ..functions.strings import connected, fix_mixed_case
from . import indent, layout, merging
from .features import with_features

PAGE = ("doc_id", "page_idx")
#: Points between a kept line and an ignored one that stands in its row.
NEAR = 20
#: Stray blocks that are compared at a time to blocks: to STEP of them first, then to twice as many each time, up to STRAYS.
STRAYS, STEP = 1024, 32


def retained(lines: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines (line_no, top, left, right, height, text, ignored) with ignored taken back where a line stands in the row of the kept line before, NEAR at most behind it.

    Of several such lines one behind the other all are taken back; a mark of punctuation alone never is.
    """
    w = Window.partitionBy(*page).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = lambda p: (F.abs(F.col("top") - p["top"]) <= F.col("height")) & (F.abs(p["right"] - F.col("left")) <= NEAR)
    box = F.struct("top", "right")
    kept = F.last(F.when(~F.col("ignored"), box), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    word = ~F.trim("text").rlike(r"^\p{Punct}*$")
    out = lines.withColumn("__n", F.row_number().over(w)).withColumn("__first", F.col("ignored") & word & F.coalesce(near(kept), F.lit(False)))
    out = out.withColumn("__next", F.col("ignored") & word & F.coalesce(near(F.lag(box).over(w)), F.lit(False)))
    begun = F.max(F.when(F.col("__first"), F.col("__n"))).over(so_far)
    ended = F.coalesce(F.max(F.when(~F.col("__next") & ~F.col("__first"), F.col("__n"))).over(so_far), F.lit(0))
    back = F.col("__first") | (F.col("__next") & F.coalesce(begun > ended, F.lit(False)))
    return out.withColumn("__back", back).withColumn("ignored", F.col("ignored") & ~F.col("__back")).drop("__n", "__first", "__next", "__back")


def in_boxes(blocks: DataFrame, boxes: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Blocks (top, left, height) that begin in one of the boxes (box: left, top, right, bottom) of their page, with their height of tolerance; an equi-join on the page, each block once."""
    met = blocks.alias("b").join(boxes.alias("x"), [F.col(f"b.{k}") == F.col(f"x.{k}") for k in keys] + [F.col("b.top").between(F.col("x.box.top") - F.col("b.height"), F.col("x.box.bottom") + F.col("b.height")), F.col("b.left").between(F.col("x.box.left"), F.col("x.box.right"))], "left_semi")
    return met


def below_numbers(footers: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Footers (key_text, top, first_page, last_page) with below_number: not above a page number's place (an empty key_text) that has their first page."""
    numbers = footers.filter("key_text = ''").select(*keys, F.col("top").alias("__top"), F.col("first_page").alias("__from"), F.col("last_page").alias("__to"))
    met = footers.join(numbers, list(keys)).filter(F.col("first_page").between(F.col("__from"), F.col("__to")) & (F.col("__top") <= F.col("top")))
    found = met.select(*keys, "key_text", "top", "first_page").distinct().withColumn("below_number", F.lit(True))
    return footers.join(found, [*keys, "key_text", "top", "first_page"], "left").withColumn("below_number", F.coalesce("below_number", F.lit(False)))


def placed(blocks: DataFrame, stray: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Where stray blocks (stray_idx, top, left, right, bottom) go among a page's blocks (block_idx, top, left, bottom): before, the block_idx that they precede, null for the end.

    Before the first block that isn't above them (of those in one row by the left edge), or one to the right that ends
    lower. A page's blocks are met in order by one task, and a stray block leaves at its first: pairs are never rows.
    """
    w = Window.partitionBy(*page).orderBy("block_idx")
    main = blocks.select(*page, "block_idx", F.col("top").alias("t"), F.col("left").alias("l"), F.col("bottom").alias("b"), F.lag("top").over(w).alias("p"))
    number = {f.name: f.dataType.simpleString() for f in [*stray.schema, *main.schema]}
    schema = ", ".join([*(f"`{c}` {number[c]}" for c in page), f"stray_idx {number['stray_idx']}", f"before {number['block_idx']}"])

    def place(key: tuple, some: pa.Table, every: pa.Table) -> pa.Table:
        every = every.filter(pc.is_valid(every["block_idx"])).sort_by("block_idx").combine_chunks()
        known = all(k.is_valid for k in key)  # a page without a key meets none
        at = _first_below(*(_numbers(some[c]) for c in ("top", "left", "right", "bottom")), *(_numbers(every[c]) for c in ("t", "l", "b", "p"))) if known else np.full(len(some), -1)
        before = every["block_idx"].take(pa.array(at, pa.int64(), mask=at < 0))
        return pa.table({**{c: some[c] for c in page}, "stray_idx": some["stray_idx"], "before": before})

    found = stray.select(*page, "stray_idx", "top", "left", "right", "bottom").groupBy(*page).cogroup(main.groupBy(*page)).applyInArrow(place, schema)
    return stray.join(found.groupBy(*page, "stray_idx").agg(F.min("before").alias("before")), [*page, "stray_idx"], "left")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as comparisons in SQL have them: nulls as NaN, which is never less nor more, and NaN as larger than all."""
    got = column.cast(pa.float64())
    return np.where(got.is_null().to_numpy(), np.nan, np.where(pc.is_nan(got).fill_null(False).to_numpy(), np.inf, got.fill_null(0.0).to_numpy()))


def _first_below(top: np.ndarray, left: np.ndarray, right: np.ndarray, bottom: np.ndarray, t: np.ndarray, l: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:  # noqa: E741
    """For each stray block the place of the first block (t, l, b; p: the top of the one before) that it goes before, or -1."""
    out = np.full(len(top), -1, np.int64)
    with np.errstate(invalid="ignore"):
        for begin in range(0, len(top), STRAYS):
            open_, at, step = np.arange(begin, min(begin + STRAYS, len(top))), 0, STEP
            while at < len(t) and len(open_):
                now = slice(at, at + step)
                top_, left_, right_, bottom_ = (x[open_, None] for x in (top, left, right, bottom))
                same = np.abs(t[now] - top_) < 0.1
                row = same & (l[now] >= left_)
                here = (t[now] >= top_) & (np.isnan(p[now]) | (top_ > p[now])) & (row | ~same)
                hit = here | row | ((t[now] < top_) & (l[now] > right_) & (bottom_ <= b[now]))
                any_ = hit.any(1)
                out[open_[any_]] = at + hit[any_].argmax(1)
                open_, at, step = open_[~any_], at + step, min(step * 2, STRAYS)
    return out


def page_words(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, word and page_idx: the last page on which each lower-case word stands; capitals inside of words begin new ones."""
    words = F.explode(F.split(F.lower(spaced_capitals(F.col("text"))), r"\s+"))
    return pages.select(*keys, "page_idx", words.alias("word")).filter("word <> ''").groupBy(*keys, "word").agg(F.max("page_idx").alias("page_idx"))


def split_words(texts: Column, starts: Column, ends: Column, size: Column) -> Column:
    """Whether a line's parts are pieces of words: four or more, of which at least half begin a font's size before another ends, or have spaces at their ends."""
    close = F.aggregate(F.transform(starts, lambda s: F.size(F.filter(ends, lambda e: F.abs(s + size - e) < 1.5))), F.lit(0), lambda a, n: a + n)
    spaces = F.aggregate(F.transform(texts, lambda t: t.startswith(" ").cast("int") + t.endswith(" ").cast("int")), F.lit(0), lambda a, n: a + n)
    n, both = F.size(texts), close + spaces
    return (n >= 4) & (both >= 2) & (F.floor(n / F.greatest(both, F.lit(1))) <= 2)


def joinable(lines: DataFrame) -> DataFrame:
    """Lines (texts) with joinable: several parts that make a paragraph or a list item when joined."""
    judged = with_features(lines.withColumn("__line", F.array_join("texts", " ")), "__line")
    return judged.select(*lines.columns, ((F.size("texts") > 1) & F.col("line_type").isin("para", "list_item")).alias("joinable"))


def plain_lines(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, line_no and line of texts without styles: compatibility forms apart, words in one case, single spaces; numbers alone and empty lines are left out."""
    forms = F.arrow_udf(lambda a: pa.array([unicodedata.normalize("NFKD", x or "") for x in a.to_pylist()], pa.string()), "string")
    split = docs.select(*keys, forms(F.coalesce(F.col(text), F.lit(""))).alias("__t")).filter(~F.trim("__t").rlike(r"^\p{N}+$"))
    words = F.filter(F.split("raw", r"(?U)\s+"), lambda w: w != "")
    out = split.select(*keys, F.posexplode(F.split("__t", "\n")).alias("line_no", "raw")).select(*keys, "line_no", F.array_join(F.transform(words, fix_mixed_case), " ").alias("line"))
    return out.filter("line <> ''")


def rejoined(lines: Column) -> Column:
    """Lines of a justified paragraph as one text: a hyphen at the end of a line goes."""
    return connected(lines)


def tops(parts: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Parts (part_idx, top) with row_top, their top in whole points, and place, their place among the parts of that row."""
    out = parts.withColumn("row_top", F.bround("top", 0))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*page, "row_top").orderBy("part_idx")) - 1)


def compressed(blocks: DataFrame) -> DataFrame:
    """Blocks without what only the layout needs: lines, cells as boxes, merge marks."""
    return blocks.drop("lines", "cells", "parts", "merge_idx", "is_aligned")


def page_blocks(lines: DataFrame, keys: Sequence[str] = ("doc_id",), by_prefix: bool = False) -> DataFrame:
    """Positioned lines to leveled blocks: layout, headers by font, merging passes, and levels by looks (by_prefix: by headers' prefixes)."""
    lines = lines.repartition(*keys)
    made = layout.font_headers(layout.layout_blocks(lines, keys), layout.style_stats(lines, keys), keys)
    width = lines.groupBy(*keys).agg(F.max("page_width").alias("page_width"))
    merged = merging.organise(made.join(width, list(keys)))
    if not by_prefix:
        return indent.indent_levels(merged, keys)
    heads = merging.numbered_levels(merged, keys).select(*keys, "block_idx", "level")
    return layout.leaf_levels(merged.join(heads, [*keys, "block_idx"], "left").withColumn("level", F.coalesce("level", F.lit(0))), keys)
