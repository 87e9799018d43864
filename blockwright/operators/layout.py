"""Positioned lines of pages: spacing statistics, repeated headers and footers, rows and cells, blocks, reading order, levels.

A line is a row (doc_id, page_idx, line_no, text, top, left, width, height, font_family, font_size, font_weight,
font_style); page sizes are columns page_width and page_height. Statistics, header and footer detection, rows, cells and
paragraph breaks are windows and groupings by document or page; nothing is folded line by line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import marker_ordinal
from .features import SENTENCE_END, line_features

# Margins as shares of the page height, gaps as multiples of the space width or the usual line gap.
HEADER_MARGIN, FOOTER_MARGIN = 0.18, 0.1
COLUMN_GAP, JUSTIFIED_GAP = 2.8, 4.0
PARAGRAPH_GAP = 1.2
TOP_TOLERANCE = 15
FUZZY = 20

STYLE = ("font_family", "font_size", "font_weight", "font_style")


def with_style_class(lines: DataFrame, keys: Sequence[str] = ("doc_id",), tolerance: float = 1.0) -> DataFrame:
    """Lines with style_class: the number of their style in its document, by first appearance. Space widths that differ by less than tolerance are one style."""
    space = F.round(F.coalesce(F.col("space_width") if "space_width" in lines.columns else F.lit(0.0), F.lit(0.0)) / tolerance) if tolerance else F.lit(0.0)
    first = F.min(F.struct("page_idx", "line_no")).over(Window.partitionBy(*keys, *STYLE, "__space"))
    return lines.withColumn("__space", space).withColumn("__first", first).withColumn("style_class", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__first")) - 1).drop("__space", "__first")


def with_gaps(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines with same_top (as the line before on the page, within a quarter of its height), space_above and gap_left to it."""
    w = Window.partitionBy(*keys, "page_idx").orderBy("line_no")
    before = F.lag(F.struct("top", "left", "width", "height", *STYLE)).over(w)
    out = lines.withColumn("__p", before)
    same = F.abs(F.col("top") - F.col("__p.top")) < F.col("__p.height") / 4
    style = F.forall(F.array(*(F.col(f"__p.{s}").cast("string").eqNullSafe(F.col(s).cast("string")) for s in STYLE)), lambda x: x)
    return out.withColumns(
        {
            "same_top": F.coalesce(same, F.lit(False)),
            "same_style": F.coalesce(F.col("__p").isNotNull() & style, F.lit(False)),
            "space_above": F.col("top") - F.col("__p.top") - F.col("__p.height"),
            "gap_left": F.when(same, F.col("left") - F.col("__p.left") - F.col("__p.width")),
        }
    ).drop("__p")


def most_frequent(column: str, order: str) -> Column:
    """The most frequent value of a column in a group, the first seen of equals."""
    return F.max_by(column, F.struct("n", -F.col(order)))


def style_stats(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document and style: lines, mean, median and population deviation of the height, and the most frequent space between its lines."""
    gaps = with_gaps(lines, keys)
    basic = gaps.groupBy(*keys, *STYLE).agg(
        F.count("*").alias("n_lines"),
        F.avg("height").alias("mean_height"),
        F.percentile("height", F.lit(0.5)).alias("median_height"),
        F.stddev_pop("height").alias("sd_height"),
    )
    spaces = gaps.filter("same_style and not same_top and space_above > 0").withColumn("space", F.round("space_above", 2))
    counted = spaces.groupBy(*keys, *STYLE, "space").agg(F.count("*").alias("n"))
    modal = counted.groupBy(*keys, *STYLE).agg(F.max_by("space", F.struct("n", -F.col("space"))).alias("modal_space"))
    return basic.join(modal, [*keys, *STYLE], "left")


def style_roles(stats: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Styles with their role: text (of the most lines), header (larger, or as large and heavier), footnote (smaller), other."""
    body = stats.groupBy(*keys).agg(F.max_by(F.struct("font_size", "font_weight"), F.struct("n_lines", "font_size")).alias("body"))
    out = stats.join(body, list(keys))
    size, weight = F.col("font_size"), F.col("font_weight")
    role = (
        F.when((size == F.col("body.font_size")) & (weight == F.col("body.font_weight")), "text")
        .when((size > F.col("body.font_size")) | ((size == F.col("body.font_size")) & (weight > F.col("body.font_weight"))), "header")
        .when(size < F.col("body.font_size"), "footnote")
        .otherwise("other")
    )
    return out.withColumn("role", role).drop("body")


def location_keys(lines: DataFrame) -> DataFrame:
    """Lines in a page's header or footer zone, with zone and key_text: numbers and lone roman numerals count as any."""
    zone = F.when(F.col("top") < F.col("page_height") * HEADER_MARGIN, "header").when(F.col("top") > F.col("page_height") * (1 - FOOTER_MARGIN), "footer")
    said = F.regexp_replace(F.when(F.col("text").rlike(r"^\s*(?:[ivxlcIVXLC]+|\d+)\s*$"), "").otherwise(F.col("text")), r"(?i)\b(page)\s+\d+(\s+of\s+\d+)?", "$1")
    return lines.withColumn("zone", zone).withColumn("key_text", F.trim(said)).filter("zone is not null")


def headers_and_footers(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Repeated lines of the margins: keys, zone, key_text, top and left of each place, and the pages on which it recurs.

    Lines of the same text within 20 points of each other are one place: the plane is cut into squares of 20, and a
    square looks into its neighbours, so the fuzzy self-join is an equi-join. A place counts if the gaps between its
    pages are 2 on average at most, and it is on more than half of the pages, on more than five, or has only a number.
    """
    marked = location_keys(lines).select(*keys, "page_idx", "zone", "key_text", F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left"))
    square = lambda c: F.floor(F.col(c) / FUZZY)
    places = marked.select(*keys, "zone", "key_text", "top", "left").distinct()
    near = places.withColumn("sy", F.explode(F.array(*(square("top") + d for d in (-1, 0, 1))))).withColumn("sx", F.explode(F.array(*(square("left") + d for d in (-1, 0, 1)))))
    other = marked.select(*keys, "zone", "key_text", "page_idx", F.col("top").alias("t"), F.col("left").alias("l")).withColumn("sy", F.floor(F.col("t") / FUZZY)).withColumn("sx", F.floor(F.col("l") / FUZZY))
    met = near.join(other, [*keys, "zone", "key_text", "sy", "sx"]).filter((F.abs(F.col("top") - F.col("t")) < FUZZY) & (F.abs(F.col("left") - F.col("l")) < FUZZY))
    pages = met.groupBy(*keys, "zone", "key_text", "top", "left").agg(F.count_distinct("page_idx").alias("n_pages"), F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page"))
    total = lines.groupBy(*keys).agg(F.count_distinct("page_idx").alias("pages"))
    gap = (F.col("last_page") - F.col("first_page")) / (F.col("n_pages") - 1)
    often = (F.col("n_pages") > F.col("pages") * 0.5) | (F.col("n_pages") > 5) | ((F.col("key_text") == "") & (F.col("n_pages") > F.col("pages") * 0.2))
    return pages.join(total, list(keys)).filter((F.col("n_pages") > 1) & (gap <= 2) & often).drop("pages")


def without_margins(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines but for repeated headers and footers, page numbers in the margins, and lines lower than a point."""
    found = headers_and_footers(lines, keys).select(*keys, "zone", "key_text", "top", "left").distinct()
    marked = location_keys(lines).select(*keys, "page_idx", "line_no", "zone", "key_text", F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left"))
    drop = marked.join(found, [*keys, "zone", "key_text", "top", "left"], "left_semi").select(*keys, "page_idx", "line_no")
    alone = marked.filter("key_text = ''").select(*keys, "page_idx", "line_no")
    return lines.filter("height >= 1").join(drop.unionByName(alone).distinct(), [*keys, "page_idx", "line_no"], "left_anti")


def rows_and_cells(lines: DataFrame, keys: Sequence[str] = ("doc_id",), space_width: float = 3.0, justified: bool = False) -> DataFrame:
    """Lines with row_idx (lines side by side are one row of a page) and is_cell: the gap before or after is wider than a column gap."""
    w = Window.partitionBy(*keys, "page_idx").orderBy("line_no")
    out = with_gaps(lines, keys).withColumn("row_idx", F.sum(F.when(F.col("same_top"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    wide = space_width * (JUSTIFIED_GAP if justified else COLUMN_GAP)
    after = F.lead("gap_left").over(w)
    return out.withColumn("is_cell", F.coalesce(F.col("gap_left") > wide, F.lit(False)) | F.coalesce(after > wide, F.lit(False)))


def layout_blocks(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks of positioned lines: keys, page_idx, block_idx, block_type, block_text, box and the style of the first line.

    A row of cells is a table row. Other rows join the one above unless the style changes, the space above is more than
    1.2 times the usual one of the style, or the line begins a list, a numbered item or follows a header. Lines are dealt
    by document once; all windows and groupings stand on that.
    """
    lines = lines.repartition(*keys)
    kept = rows_and_cells(without_margins(lines, keys), keys)
    row = [*keys, "page_idx", "row_idx"]
    parts = F.sort_array(F.collect_list(F.struct("line_no", "text", "left")))
    rows = kept.groupBy(*row).agg(
        parts.alias("parts"),
        F.max("is_cell").alias("is_row"),
        F.min("top").alias("top"),
        F.min("left").alias("left"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        *(F.min_by(s, "line_no").alias(s) for s in STYLE),
    )
    rows = rows.withColumn("text", F.array_join("parts.text", " ")).withColumn("cells", F.col("parts.text"))
    rows = rows.join(style_stats(lines, keys).select(*keys, *STYLE, "modal_space"), [*keys, *STYLE], "left")
    judged = line_features(rows.withColumnRenamed("text", "line"), "line")
    w = Window.partitionBy(*keys).orderBy("page_idx", "row_idx")
    p = F.lag(F.struct("page_idx", "bottom", "is_row", "line_type", "ends_with_period", "incomplete_line", *STYLE)).over(w)
    judged = judged.withColumn("__p", p)
    restyled = ~F.forall(F.array(*(F.col(f"__p.{s}").cast("string").eqNullSafe(F.col(s).cast("string")) for s in STYLE)), lambda x: x)
    turned = F.col("__p.page_idx") != F.col("page_idx")
    apart = ~turned & (F.col("top") - F.col("__p.bottom") > F.coalesce("modal_space", F.lit(0.0)) * PARAGRAPH_GAP + 0.5)
    begins = F.col("line_type").isin("list_item") | F.col("numbered_line") | (F.col("__p.line_type") == "header") & ~F.col("__p.incomplete_line")
    new = F.col("__p").isNull() | F.col("is_row") | F.col("__p.is_row") | restyled | apart | begins | (turned & F.col("__p.ends_with_period"))
    numbered = judged.withColumn("block_idx", (F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int"))
    texts = F.sort_array(F.collect_list(F.struct("page_idx", "row_idx", F.col("line").alias("text"))))
    first = F.min_by(F.struct("page_idx", "row_idx", "line_type", "is_row", "cells", *STYLE), F.struct("page_idx", "row_idx")).alias("f")
    box = F.struct(F.min("top").alias("top"), F.min("left").alias("left"), (F.max("right") - F.min("left")).alias("width"), (F.max("bottom") - F.min("top")).alias("height")).alias("box")
    out = numbered.groupBy(*keys, "block_idx").agg(texts.alias("t"), first, box, F.count("*").alias("n"))
    kind = F.when(F.col("f.is_row"), "table_row").when(F.col("f.line_type").isin("table_row"), "para").when((F.col("n") > 1) & (F.col("f.line_type") != "list_item"), "para").otherwise(F.col("f.line_type"))
    return out.select(*keys, "f.page_idx", "block_idx", kind.alias("block_type"), F.regexp_replace(F.array_join("t.text", " "), "- ", "-").alias("block_text"), "box", F.when(F.col("f.is_row"), F.col("f.cells")).alias("cell_values"), *(f"f.{s}" for s in STYLE))


def reading_runs(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_idx")) -> DataFrame:
    """Runs of blocks whose tops don't fall by more than the tolerance: keys, run_idx, first and last block, the share of the page's blocks."""
    w = Window.partitionBy(*keys).orderBy("block_idx")
    back = F.col("top") < F.lag("top").over(w) - TOP_TOLERANCE
    out = blocks.withColumn("run_idx", F.sum(F.when(back, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = out.groupBy(*keys, "run_idx").agg(F.min("block_idx").alias("first_block"), F.max("block_idx").alias("last_block"), F.count("*").alias("n"), F.min("left").alias("left"), F.max(F.col("left") + F.col("width")).alias("right"))
    return runs.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def reading_order(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_idx"), small: float = 0.2) -> DataFrame:
    """Blocks with order. On a page of several runs:

    - Runs with at least the small share of blocks that lie side by side are columns, read from the left; blocks of
      smaller runs go into the column that they overlap most, by their top.
    - Exactly two runs that overlap in x are merged by the blocks' place from above.
    - Otherwise blocks stay as they come.

    Overlapping tops aren't an order among three blocks, so the key is the top in steps of the tolerance, then the left edge.
    """
    runs = reading_runs(blocks, keys)
    large = runs.filter(F.col("ratio") >= small)
    order = Window.partitionBy(*keys).orderBy("left", "right")
    reach = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    split = large.withColumn("__new", F.when(reach.isNull() | (F.col("left") >= reach), 1).otherwise(0))
    numbered = split.withColumn("column", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    columns = numbered.groupBy(*keys, "column").agg(F.min("left").alias("from"), F.max("right").alias("to"))
    lists = columns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("column", "from", "to"))).alias("columns"))  # a few a page
    page = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.max("left").alias("l"), F.min("right").alias("r")).join(lists, list(keys), "left")
    out = blocks.join(page, list(keys))
    right = F.col("left") + F.col("width")
    best = F.array_max(F.transform("columns", lambda c: F.struct((F.least(right, c["to"]) - F.greatest(F.col("left"), c["from"])).alias("shared"), (-c["column"]).alias("minus"))))
    side = (F.size("columns") > 1) & (F.col("runs") > 1)
    merge = ~side & (F.col("runs") == 2) & (F.col("l") < F.col("r"))
    column = F.when(side, -best["minus"]).otherwise(0)
    step = F.when(side | merge, F.floor(F.col("top") / TOP_TOLERANCE)).otherwise(0)
    left = F.when(side | merge, F.col("left")).otherwise(0.0)
    placed = out.withColumn("__c", column).withColumn("__s", step).withColumn("__l", left)
    return placed.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("__c", "__s", "__l", "block_idx")) - 1).drop("runs", "l", "r", "columns", "__c", "__s", "__l")


def font_headers(blocks: DataFrame, stats: DataFrame, keys: Sequence[str] = ("doc_id",), words: int = 16) -> DataFrame:
    """Blocks in which short paragraphs and list items in a header style are headers, unless one of that style ends a sentence (then the style is no header's)."""
    roles = style_roles(stats, keys).select(*keys, *STYLE, "role")
    out = blocks.join(roles, [*keys, *STYLE], "left")
    text = F.col("block_type").isin("para", "list_item")
    style = Window.partitionBy(*keys, *STYLE)
    spoiled = F.max(text & F.col("block_text").rlike(SENTENCE_END) & ~F.col("block_text").endswith(":")).over(style)
    short = F.size(F.split(F.trim("block_text"), r"\s+")) < words
    kind = F.when(text & (F.col("role") == "header") & short & ~F.coalesce(spoiled, F.lit(False)), "header").otherwise(F.col("block_type"))
    return out.withColumn("block_type", kind).drop("role")


def header_rank(headers: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Headers with level: 0 for the weightiest look. Nine keys: centred capitals with a number, size, weight, style (bold over normal over italic), number, upper-case number, capitals, not centred, left edge."""
    style = F.when(F.col("font_style") == "bold", 3).when(F.col("font_style") == "italic", 1).otherwise(2)
    prefix = F.col("prefix") != ""
    order = [
        F.desc(F.col("is_centered") & F.col("is_caps") & prefix),
        F.desc("font_size"),
        F.desc("font_weight"),
        style.desc(),
        prefix.desc(),
        F.col("prefix").rlike(r"^\p{Lu}").desc(),
        F.desc("is_caps"),
        F.asc("is_centered"),
        F.asc("left"),
    ]
    return headers.withColumn("level", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def leaf_levels(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks (header levels known) with level: paragraphs and rows stand one below the last header, list items one deeper after a colon."""
    w = Window.partitionBy(*keys).orderBy("block_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.coalesce(F.last(F.when(F.col("block_type") == "header", F.col("level")), ignorenulls=True).over(so_far), F.lit(-1)) + 1
    listed = F.col("block_type") == "list_item"
    opens = listed & (F.lag("block_type").over(w) != "list_item") & F.lag("block_text").over(w).endswith(":")
    out = blocks.withColumn("__base", base).withColumn("__list", F.when(listed, F.sum(F.when(~listed, 1).otherwise(0)).over(so_far))).withColumn("__opens", opens)
    deeper = F.max("__opens").over(Window.partitionBy(*keys, "__list"))
    level = F.when(F.col("block_type") == "header", F.col("level")).when(listed & F.coalesce(deeper, F.lit(False)), F.col("__base") + 1).otherwise(F.col("__base"))
    return out.withColumn("level", level.cast("int")).drop("__base", "__list", "__opens")


def list_continues(markers: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """List items (block_idx, marker) with ordinal, and whether it follows the one before by one or two."""
    w = Window.partitionBy(*keys).orderBy("block_idx")
    out = markers.withColumn("ordinal", marker_ordinal(F.col("marker")))
    return out.withColumn("continues", F.coalesce((F.col("ordinal") - F.lag("ordinal").over(w)).between(1, 2), F.lit(False)))


def titles(lines: DataFrame, keys: Sequence[str] = ("doc_id",), first_pages: int = 2) -> DataFrame:
    """keys, title and subtitle: the lines of the largest and second largest font in the top half of the first pages, side by side ones joined."""
    top = lines.filter((F.col("page_idx") < first_pages) & (F.col("top") < F.col("page_height") / 2) & (F.length(F.trim("text")) > 2))
    ranked = top.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("font_size")))).filter("rank <= 2")
    order = Window.partitionBy(*keys, "rank").orderBy("page_idx", "line_no")
    run = F.sum(F.when((F.col("line_no") - F.lag("line_no").over(order) > 1) | (F.col("page_idx") != F.lag("page_idx").over(order)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = ranked.withColumn("run", run).filter("run = 0")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_idx", "line_no", "text"))), lambda x: x["text"]), " ")
    by_rank = first.groupBy(*keys, "rank").agg(said.alias("t"))
    return by_rank.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("t"))).alias("title"), F.max(F.when(F.col("rank") == 2, F.col("t"))).alias("subtitle"))


def table_of_contents(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), pages: int = 4, share: float = 0.67) -> DataFrame:
    """Blocks with is_toc: rows of a run of two-cell rows on the first pages of which at least the share begin with a header's text."""
    w = Window.partitionBy(*keys).orderBy("block_idx")
    two = (F.col("block_type") == "table_row") & (F.size("cell_values") == 2) & (F.col("page_idx") < pages)
    out = blocks.withColumn("__two", F.coalesce(two, F.lit(False)))
    out = out.withColumn("__run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "__two").orderBy("block_idx")))
    heads = blocks.filter("block_type = 'header'").select(*keys, F.lower(F.trim("block_text")).alias("__t")).distinct().withColumn("__known", F.lit(1.0))
    out = out.withColumn("__t", F.lower(F.trim(F.get("cell_values", F.lit(0))))).join(heads, [*keys, "__t"], "left")
    hit = F.avg(F.coalesce("__known", F.lit(0.0))).over(Window.partitionBy(*keys, "__two", "__run"))
    return out.withColumn("is_toc", F.col("__two") & (hit >= share)).drop("__two", "__run", "__t", "__known")
