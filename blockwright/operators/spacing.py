"""What the spacing of lines tells: page statistics, headers by rare fonts and narrow lines, rows that go on.

A line is a row (keys, page_idx, line_no, text, left, right, top, font_size, font_weight, starts, ends, texts), the last
three of its parts. Statistics are groupings by page; comparisons are windows, a line with the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import with_features

# Points between parts that count as a tab, and the weight from which a font is bold.
TAB, BOLD = 20, 600
PAGE = ("doc_id", "page_idx")


def tabs(starts: Column, ends: Column) -> Column:
    """How many gaps between parts are wider than TAB; none if there aren't as many begins as ends."""
    wide = F.filter(F.transform(starts, lambda s, i: F.when(i > 0, s - F.get(ends, F.greatest(i - 1, F.lit(0))))), lambda g: g > TAB)
    return F.when(F.size(starts) == F.size(ends), F.size(wide)).otherwise(0)


def line_steps(lines: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines with step_before and step_after (whole points from top to top; -1 at the page's ends), tabs, and rounded_length (tens of points)."""
    w = Window.partitionBy(*page).orderBy("line_no")
    before, after = F.lag("top").over(w), F.lead("top").over(w)
    return lines.withColumns(
        {
            "step_before": F.coalesce(F.bround(F.col("top") - before, 0), F.lit(-1.0)),
            "step_after": F.coalesce(F.bround(after - F.col("top"), 0), F.lit(-1.0)),
            "tabs": tabs(F.col("starts"), F.col("ends")),
            "rounded_length": (F.floor((F.col("right") - F.col("left")).cast("int") / 10) * 10).cast("int"),
        }
    )


def page_stats(stepped: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Of each page: n_lines, the most frequent font size, weight and length (the first of equals), the median size, how many sizes, and the largest."""

    def most(name: str) -> DataFrame:
        counted = stepped.groupBy(*page, name).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
        return counted.groupBy(*page).agg(F.max_by(name, F.struct("n", -F.col("first"))).alias(f"mode_{name}"))

    basic = stepped.groupBy(*page).agg(F.count("*").alias("n_lines"), F.percentile("font_size", F.lit(0.5)).alias("median_size"), F.count_distinct("font_size").alias("sizes"), F.max("font_size").alias("largest"))
    for name in ("font_size", "font_weight", "rounded_length"):
        basic = basic.join(most(name), list(page))
    return basic


def size_shares(stepped: DataFrame, page: Sequence[str] = PAGE) -> Column:
    """The share of a page's lines that have a line's font size (to a thousandth); a window."""
    return F.count("*").over(Window.partitionBy(*page, F.bround("font_size", 3))) / F.count("*").over(Window.partitionBy(*page))


def looks(stepped: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines with is_large, is_bold (against the page's most frequent font) and whether the step to either neighbour is one that its font often has."""
    often = lambda step: F.count("*").over(Window.partitionBy(*page, F.bround("font_size", 1), step)) > 2
    out = stepped.join(page_stats(stepped, page), list(page))
    return out.withColumns(
        {
            "is_large": F.col("font_size") > F.col("mode_font_size") * 4 / 3,
            "is_bold": (F.col("mode_font_weight") < BOLD) & (F.col("font_weight") > BOLD),
            "usual_before": often("step_before"),
            "usual_after": often("step_after"),
            "size_share": size_shares(stepped, page),
        }
    )


def rare_font_header(size: Column, after: Column, share: Column, median: Column, largest: Column, sizes: Column) -> Column:
    """Whether a line is a header by its font: at most 8 % of a page of four sizes or more, well above the median, and larger than (or as large as) the line after."""
    middle, top = F.bround(median, 0), F.bround(largest, 0)
    above = F.bround(size - middle, 0)
    next_above = F.bround(after - middle, 0)
    next_above = F.when(next_above == 0, 0.8).otherwise(next_above)
    big = F.when(top == 0, True).otherwise((top - size) / top < 0.2) | (above / next_above > 2)
    return (sizes >= 4) & (share <= 0.08) & big & (above > 1) & ((above - next_above > 0.3) | (size == after))


def narrow_header(before: Column, line: Column) -> Column:
    """Whether the line before (struct: left, right, top, font_size, font_weight, line_type) heads a line: higher, and narrower than 0.3 of it, or 0.6 in another font."""
    width, own = before["right"] - before["left"], line["right"] - line["left"]
    offset = F.when(before["left"] <= line["left"], line["left"] - before["left"]).otherwise(0.0)
    share = F.when(own != 0, (width - offset) / F.when(own != 0, own))
    alike = (F.bround(before["left"], 0) == F.bround(line["left"], 0)) & (F.bround(width, 0) == F.bround(own, 0))
    restyled = (before["font_weight"] != line["font_weight"]) | (before["font_size"] > line["font_size"])
    narrow = (share < 0.3) | (restyled & (share < 0.6)) | ((before["line_type"] == "header") & restyled)
    return (before["top"] < line["top"]) & (own != 0) & ~alike & F.coalesce(narrow, F.lit(False))


def usual_step(stepped: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines with joins_by_step: the step from the line before is, within a point, the smallest of those that its font has more than twice on the page.

    The step itself must be there more than three times, or one a point off at all.
    """
    counted = stepped.groupBy(*page, "font_size", "step_before").agg(F.count("*").alias("n"))
    smallest = counted.filter("step_before > 0 and n > 2").groupBy(*page, "font_size").agg(F.min("step_before").alias("smallest"))
    steps = counted.groupBy(*page, "font_size").agg(F.map_from_entries(F.collect_list(F.struct("step_before", "n"))).alias("counts"))
    out = stepped.join(smallest, [*page, "font_size"], "left").join(steps, [*page, "font_size"])
    step, known = F.col("step_before"), lambda s: F.try_element_at("counts", s)
    there = known(step - 1).isNotNull() | (known(step) > 3) | known(step + 1).isNotNull()
    return out.withColumn("joins_by_step", F.coalesce((step >= 0) & there & (F.abs(step - F.col("smallest")) <= 1), F.lit(False))).drop("smallest", "counts")


def parts_aligned(before: Column, line: Column) -> Column:
    """Whether the parts of two lines (structs with texts and starts) begin within 100 points, and there is at most one more in either."""
    n, m = F.size(before["texts"]), F.size(line["texts"])
    k = F.least(F.size(before["starts"]), F.size(line["starts"]))
    near = F.zip_with(F.slice(before["starts"], F.lit(1), k), F.slice(line["starts"], F.lit(1), k), lambda a, b: F.abs(F.bround(a, 0) - F.bround(b, 0)) <= 100)
    return (n > 1) & (F.abs(n - m) <= 1) & F.forall(near, lambda x: x)


def row_goes_on(before: Column, line: Column, aligned: Column) -> Column:
    """Whether a line (struct: texts, tabs, text, incomplete_line) is a further row: as many parts and tabs, or parts that are aligned, or both with a colon and in one case."""
    parts = (F.size(before["texts"]) == F.size(line["texts"])) & (F.size(before["texts"]) >= 2)
    same_tabs = (before["tabs"] == line["tabs"]) & (line["tabs"] > 0)
    first = lambda s: F.substring(s["text"], 1, 1)
    case = (first(before).rlike(r"\p{Ll}") == first(line).rlike(r"\p{Ll}")) | (first(before).rlike(r"\p{Lu}") == first(line).rlike(r"\p{Lu}"))
    colons = before["text"].contains(":") & line["text"].contains(":") & case & ~before["incomplete_line"]
    return (same_tabs & parts) | colons | (aligned & parts & ((before["tabs"] > 0) | (line["tabs"] > 0)))


def misplaced(before: Column, line: Column) -> Column:
    """Whether a line lies over the x of the one before without being below it."""
    low, high = F.least(before["left"].cast("int"), before["right"].cast("int")), F.greatest(before["left"].cast("int"), before["right"].cast("int"))
    shared = F.least(high, line["right"].cast("int")) > F.greatest(low, line["left"].cast("int"))
    return shared & ~(before["top"] < line["top"])


def key_value(before: Column, line: Column) -> Column:
    """Whether a line is the value beside the key before it: not below, not to the left, and their lines overlap."""
    return (before["top"] >= line["top"]) & (before["left"] <= line["left"]) & (before["top"] - before["font_size"] < line["top"] + line["font_size"])


def same_mark(before: Column, line: Column, mark: Column) -> Column:
    """Whether a line goes on a list: it begins with the list's mark, or with the sign (no letter, digit, quote or bracket) that the line before begins with."""
    first, old = F.substring(line, 1, 1), F.substring(before, 1, 1)
    quotes = ("”", "'", '"', "(")
    return ((first == mark) & ~mark.isin(*quotes)) | ((first == old) & ~old.rlike(r"[\p{L}\p{Nd}]") & mark.isin(*quotes))


def joined_pages(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks (page_idx, block_idx, block_type, block_text) in which a page's last paragraph goes on in the next page's first one, if it is incomplete or that one continues.

    Chains of such pages are one block, on the first one's page; block_idx is anew.
    """
    judged = with_features(blocks.withColumnRenamed("block_text", "__raw"), "__raw").select(*(c if c != "block_text" else F.col("__raw").alias("block_text") for c in blocks.columns), "incomplete_line", "continuing_line")
    w = Window.partitionBy(*keys).orderBy("page_idx", "block_idx")
    before = F.lag(F.struct("page_idx", "block_type", "block_text", "incomplete_line")).over(w)
    out = judged.withColumn("__p", before)
    paragraphs = (F.col("block_type") == "para") & (F.col("__p.block_type") == "para") & (F.trim("block_text") != "") & (F.trim("__p.block_text") != "")
    on = (F.col("page_idx") != F.col("__p.page_idx")) & paragraphs & (F.col("__p.incomplete_line") | F.col("continuing_line"))
    out = out.withColumn("__on", F.coalesce(on, F.lit(False)))
    out = out.withColumn("__run", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.sort_array(F.collect_list(F.struct("page_idx", "block_idx", "block_text")))
    n = F.size(parts)
    text = F.array_join(F.transform(parts, lambda x, i: F.when((i > 0) & (i < n - 1), F.trim(x["block_text"])).when(i > 0, F.ltrim(x["block_text"])).when(n > 1, F.rtrim(x["block_text"])).otherwise(x["block_text"])), " ")
    grouped = out.groupBy(*keys, "__run").agg(F.min("page_idx").alias("__page"), F.min_by("block_type", F.struct("page_idx", "block_idx")).alias("block_type"), text.alias("block_text"))
    return grouped.select(*keys, F.col("__page").alias("page_idx"), (F.col("__run") - 1).cast("int").alias("block_idx"), "block_type", "block_text")


def headers_of_rows(rows: DataFrame, keys: Sequence[str] = ("doc_id", "block_idx"), share: float = 0.75) -> DataFrame:
    """Rows (row_idx, text) of paragraphs with is_heading: more than the share of the paragraph's rows are headers made of names mostly; such a paragraph is a header a row."""
    judged = with_features(rows.withColumnRenamed("text", "__raw"), "__raw", chunks=True)
    named = F.array_join("noun_chunks", " ")
    content = F.col("word_count") - F.col("stop_word_count")
    mostly = (F.regexp_replace("text", r"\p{Punct}", "") == named) | (F.when(content > 0, F.size(F.split(F.trim(named), r"\s+")) / F.when(content > 0, content)) > share)
    head = F.col("is_header") & (F.size("noun_chunks") > 0) & F.coalesce(mostly, F.lit(False))
    out = judged.select(*keys, "row_idx", F.col("__raw").alias("text"), F.coalesce(head, F.lit(False)).alias("__head"))
    block = Window.partitionBy(*keys)
    return out.withColumn("is_heading", (F.count("*").over(block) > 1) & (F.avg(F.col("__head").cast("int")).over(block) > share)).drop("__head")
