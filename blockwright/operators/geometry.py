"""Cells of rows and boxes on pages: who stands beside, below or within whom, gaps between cells, columns of a page.

A cell is a struct with top, left, right, height and text; a row or block is an array of cells in their order. Rules on
one row are columns over its array; rules on a page are windows by page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Points between lefts of one column, and between tops of one part of it.
LEFT_STEP, TOP_STEP = 20, 35
#: A gap so many times the smallest one may be a column's.
WIDE = 3
#: Cells are aligned if edges or centers differ by this share at most.
ALIGNED = 0.1


def same_top(cell: Column, before: Column) -> Column:
    """Whether a cell is in the row of another: by their middles, or by a quarter of the other's height."""
    middle = lambda c: c["top"] + c["height"] / 2
    return (F.abs(middle(cell) - middle(before)) / middle(cell) < 0.005) | (F.abs(cell["top"] - before["top"]) < before["height"] / 4)


def _steps(cells: Column) -> Column:
    """Of each cell, whether it begins another row than the one before (the first doesn't)."""
    return F.transform(cells, lambda c, i: F.when(i == 0, False).otherwise(~same_top(c, F.get(cells, F.greatest(i - 1, F.lit(0))))))


def column_count(cells: Column) -> Column:
    """How many cells the first row has."""
    at = F.array_position(_steps(cells), True)
    return F.when(at > 0, at - 1).otherwise(F.size(cells)).cast("int")


def first_same_top(cells: Column) -> Column:
    """The place of the first later cell in the first one's row; the last place if there is none."""
    later = F.transform(cells, lambda c, i: (i > 0) & same_top(c, F.get(cells, F.lit(0))))
    at = F.array_position(later, True)
    return F.when(at > 0, at - 1).otherwise(F.greatest(F.size(cells) - 1, F.lit(0))).cast("int")


def row_changes(cells: Column) -> Column:
    return F.size(F.filter(_steps(cells), lambda x: x))


def row_spaces(cells: Column) -> Column:
    """The spaces between a row's last cell and the next row's first one, where that is lower."""
    steps = F.transform(cells, lambda c, i: F.struct(F.get(cells, F.greatest(i - 1, F.lit(0))).alias("p"), c.alias("c"), F.get(_steps(cells), i).alias("new")))
    return F.transform(F.filter(steps, lambda s: s["new"] & (s["p"]["top"] < s["c"]["top"])), lambda s: s["c"]["top"] - s["p"]["top"] - s["p"]["height"])


def mean_row_space(cells: Column) -> Column:
    spaces = row_spaces(cells)
    return F.when(F.size(spaces) > 0, F.aggregate(spaces, F.lit(0.0), lambda a, x: a + x) / F.size(spaces)).otherwise(0.0)


def _meet(a: Column, b: Column) -> Column:
    return F.least(a["right"].cast("int"), b["right"].cast("int")) >= F.greatest(a["left"].cast("int"), b["left"].cast("int"))


def column_cells(cells: Column) -> Column:
    """The cells that none before shares a whole point of x with: one for each column of a block."""
    first = F.filter(cells, lambda c: F.lit(False))
    return F.aggregate(cells, first, lambda found, c: F.when(F.exists(found, lambda x: _meet(x, c)), found).otherwise(F.concat(found, F.array(c))))


def gaps(cells: Column) -> Column:
    """The spaces between cells, to a tenth of a point; the indent of the first doesn't count."""
    return F.slice(F.transform(cells, lambda c, i: F.bround(c["left"] - F.get(cells, F.greatest(i - 1, F.lit(0)))["right"], 1)), F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))


def wide_gaps(found: Column) -> Column:
    """n and threshold: how many gaps are more than WIDE times the smallest, and the smallest of those (0 if none is)."""
    wide = F.filter(found, lambda g: g > F.array_min(found) * WIDE)
    return F.struct(F.size(wide).alias("n"), F.coalesce(F.array_min(wide), F.lit(0.0)).alias("threshold"))


def center(left: Column, right: Column) -> Column:
    return left + (right - left) / 2


def cells_by_gap(cells: Column, threshold: Column) -> Column:
    """Cells put together but for gaps of at least the threshold: structs (text, left, right, center); none of fewer than two cells."""
    new = F.transform(cells, lambda c, i: (i > 0) & (F.bround(c["left"] - F.get(cells, F.greatest(i - 1, F.lit(0)))["right"], 0) >= threshold))
    numbered = F.transform(cells, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(new, F.lit(1), i + 1), lambda x: x)).alias("run")))

    def made(run: Column) -> Column:
        own = F.transform(F.filter(numbered, lambda x: x["run"] == run), lambda x: x["c"])
        left, right = F.get(own, F.lit(0))["left"], F.element_at(own, -1)["right"]
        return F.struct(F.array_join(F.transform(own, lambda c: c["text"]), " ").alias("text"), left.alias("left"), right.alias("right"), center(left, right).alias("center"))

    runs = F.sequence(F.lit(0), F.size(F.filter(new, lambda x: x)))
    return F.when(F.size(cells) > 1, F.transform(runs, made)).otherwise(F.array().cast("array<struct<text:string,left:double,right:double,center:double>>"))


def centers_match(cells: Column, made: Column) -> Column:
    """Whether the centers of a row's cells, from the second on, are those of others on the whole (whole points, added up)."""
    n = F.least(F.size(cells) - 1, F.size(made))
    pairs = F.zip_with(F.slice(cells, F.lit(2), F.greatest(n, F.lit(0))), F.slice(made, F.lit(1), F.greatest(n, F.lit(0))), lambda c, m: (center(c["left"], c["right"]) - m["center"]).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x) == 0


def right_edges_match(cells: Column, before: Column) -> Column:
    """Whether the right edges of a row's cells, from the second on, are within two points of those of the row before."""
    n = F.greatest(F.least(F.size(cells) - 1, F.size(before)), F.lit(0))
    pairs = F.zip_with(F.slice(cells, F.lit(2), n), F.slice(before, F.lit(1), n), lambda c, b: F.abs(c["right"] - b["right"]) <= 2)
    return (n > 0) & F.forall(pairs, lambda x: x)


def hidden_row(before: Column, cells: Column) -> Column:
    """The cells of a block before a table row that is a row itself, by its gaps and the row's centers or right edges; null if it isn't."""
    ends = lambda c: (F.get(c, F.lit(0))["left"].cast("int"), F.element_at(c, -1)["right"].cast("int"))
    (a0, a1), (b0, b1) = ends(before), ends(cells)
    shorter = F.least(a1 - a0, b1 - b0)
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)) / F.when(shorter > 0, shorter).otherwise(1)
    own, theirs = gaps(before), gaps(cells)
    usual = wide_gaps(own)["threshold"]
    threshold = F.when(F.array_min(theirs) * 0.75 < F.array_max(own), F.bround(F.array_min(own), 0)).otherwise(usual)
    made = cells_by_gap(before, threshold)
    possible = (F.bround(shared, 0) == 1) & (F.size(F.array_distinct(own)) > 1) & (F.size(theirs) > 0) & (threshold != 0)
    return F.when(possible & (centers_match(cells, made) | right_edges_match(cells, before)), F.transform(made, lambda m: m["text"]))


def alignment(before: Column, cells: Column) -> Column:
    """n and places: how many cells of the shorter row are aligned with a cell of the other, left, right, by centers or by x, and with which."""
    shorter = F.when(F.size(before) < F.size(cells), before).otherwise(cells)
    longer = F.when(F.size(before) < F.size(cells), cells).otherwise(before)
    near = lambda a, b: F.when(a != 0, F.abs((a - b) / a) <= ALIGNED).otherwise(False)
    reach = lambda c: (c["right"] - c["left"]) / 2 + c["right"]
    shared = lambda s, l: F.least(s["right"].cast("int"), l["right"].cast("int")) + 1 - F.greatest(s["left"].cast("int"), l["left"].cast("int"))  # noqa: E741, E731

    def place(s: Column, i: Column) -> Column:
        meets = F.transform(longer, lambda l: near(s["left"], l["left"]) | near(s["right"], l["right"]) | near(reach(s), reach(l)) | (F.greatest(shared(s, l), F.lit(0)) >= F.length(s["text"])))  # noqa: E741
        at = F.array_position(meets, True).cast("int") - 1
        found = F.get(longer, F.greatest(at, F.lit(0)))
        lost = near(s["left"], found["left"]) & (at == F.size(longer) - 1) & (shared(s, found) <= 0)  # the last cell's left only, far from it
        one, two = F.get(longer, F.lit(0)), F.get(longer, F.lit(1))
        inside = (i == 0) & (F.size(longer) > 1) & s["left"].between(one["left"], two["left"]) & (s["left"] < two["left"]) & (s["right"] >= one["left"]) & (s["right"] < two["left"])
        return F.when((at >= 0) & ~lost, at).when((at < 0) & F.coalesce(inside, F.lit(False)), 0)

    places = F.filter(F.transform(shorter, place), lambda x: x.isNotNull())
    return F.struct(F.size(places).alias("n"), places.alias("places"))


def alignment_breaks(n: Column, columns: Column, places: Column) -> Column:
    """Whether an alignment is too poor for a table to go on: fewer than two cells, or less than half of the columns and none beyond them."""
    few = (F.array_max(places) <= n) & (n / columns < 0.5)
    return F.when(columns > 1, (n < 2) | F.coalesce(few, F.lit(False))).otherwise(n < 1)


def beside_second_column(before: Column, cells: Column, page_width: Column, same_style: Column, header: Column | None = None) -> Column:
    """Whether a block goes on in the second column of the row before: its left within 80 points of that cell's, which is beyond a sixth of the page, in one style."""
    heading = F.lit(False) if header is None else header
    second = F.when(column_count(before) == 1, F.get(before, first_same_top(before))).when(heading, F.get(before, F.lit(0))).otherwise(F.element_at(before, -1))
    own = F.get(cells, F.lit(0))
    aligned = (F.abs(own["left"] - second["left"]) < 80) & (second["left"] > page_width / 6) & same_style
    spans = heading & (own["right"] > F.element_at(before, -1)["left"])
    return (F.size(before) > 1) & aligned & ~spans


def joined_cell(first: Column, second: Column, text: Column) -> Column:
    """Two cells as one: the first one's top and left, the second one's right, the height from the upper one's top to the lower one's bottom."""
    bottom = lambda c: c["top"] + c["height"]
    height = F.when(first["top"] < second["top"], bottom(second) - first["top"]).when(first["top"] > second["top"], bottom(first) - second["top"]).otherwise(F.greatest(first["height"], second["height"]))
    return F.struct(first["top"].alias("top"), first["left"].alias("left"), second["right"].alias("right"), height.alias("height"), text.alias("text"))


def possible_cells(cells: Column, normal_gap: Column, numbered: Column) -> Column:
    """How many gaps are wider than a normal one; none of a numbered line."""
    return F.when(numbered, 0).otherwise(F.size(F.filter(gaps(cells), lambda g: g > normal_gap)))


def in_middle_third(top: Column, height: Column, page_height: Column) -> Column:
    return (top + height).between(page_height / 3, page_height * 2 / 3)


def nearly_left(left: Column, other: Column) -> Column:
    return F.abs(left - other) < 0.2


def within(top: Column, left: Column, height: Column, bound: Column) -> Column:
    """Whether a box begins in a rectangle (left, top, right, bottom), with its own height of tolerance above and below."""
    return top.between(bound["top"] - height, bound["bottom"] + height) & left.between(bound["left"], bound["right"])


def whole_within(top: Column, left: Column, right: Column, height: Column, bound: Column) -> Column:
    """Whether a box lies in a rectangle as a whole."""
    return top.between(bound["top"], bound["bottom"]) & left.between(bound["left"], bound["right"]) & (top + height <= bound["bottom"]) & (right <= bound["right"])


def overlap_from_top(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of the lower interval b that lies below the upper one's (a) begin: 1 if it is in a, negative or over 1 where it sticks out."""
    width = F.abs(b1 - b0)
    return F.when(width == 0, 0.0).when((a0 <= b0) & (b1 <= a1), 1.0).when((a0 > b0) & (b1 <= a0), 0.0).otherwise((b1 - a0) / width)


def overlap_below(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The lower interval's length over the upper one's, if they begin at one place; else 1."""
    return F.when((a0 == b0) & (a1 != a0), (b1 - b0) / (a1 - a0)).otherwise(1.0)


def column_clusters(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_idx")) -> DataFrame:
    """Blocks (block_idx, top, left) with column and part: lefts in steps of less than LEFT_STEP are a column, tops in it in steps of less than TOP_STEP a part.

    A part of one block goes to the next part of its column, as often as it takes to have two. A page of one column has
    part null.
    """
    by_left = Window.partitionBy(*keys).orderBy("left", "top", "block_idx")
    new = F.abs(F.col("left") - F.lag("left").over(by_left)) >= LEFT_STEP
    out = blocks.withColumn("column", F.sum(F.when(new, 1).otherwise(0)).over(by_left.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    by_top = Window.partitionBy(*keys, "column").orderBy("top", "left", "block_idx")
    apart = F.abs(F.col("top") - F.lag("top").over(by_top)) >= TOP_STEP
    out = out.withColumn("__run", F.sum(F.when(apart, 1).otherwise(0)).over(by_top.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sizes = out.groupBy(*keys, "column", "__run").agg(F.count("*").alias("n")).groupBy(*keys, "column").agg(F.sort_array(F.collect_list(F.struct("__run", "n"))).alias("runs"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("parts"))

    def step(s: Column, r: Column) -> Column:
        closes = s["held"] > 1
        part = F.when(closes, s["part"] + 1).otherwise(s["part"])
        return F.struct(F.when(closes, r["n"]).otherwise(s["held"] + r["n"]).alias("held"), part.alias("part"), F.concat(s["parts"], F.array(part)).alias("parts"))

    parts = sizes.select(*keys, "column", F.posexplode(F.aggregate("runs", start, step, lambda s: s["parts"])).alias("__run", "part"))
    several = F.max("column").over(Window.partitionBy(*keys)) > 0
    return out.join(parts, [*keys, "column", "__run"]).withColumn("part", F.when(several, F.col("part"))).drop("__run")


def merged_in_column(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_idx", "column")) -> DataFrame:
    """Blocks (block_idx, top, block_type, block_text, font_size) of a column with merge_idx: paragraphs that go on a list item above, which ends no sentence, within 1.1 of the font size."""
    w = Window.partitionBy(*keys).orderBy("top", "block_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (F.col("block_type") == "para") & ~F.lag("block_text").over(w).endswith(".") & (F.col("top") - F.lag("top").over(w) <= F.lag("font_size").over(w) * 1.1)
    out = blocks.withColumn("__n", F.row_number().over(w)).withColumn("__fits", F.coalesce(fits, F.lit(False))).withColumn("__item", F.coalesce(F.lag("block_type").over(w) == "list_item", F.lit(False)))
    begun = F.max(F.when(F.col("__fits") & F.col("__item"), F.col("__n"))).over(so_far)
    ended = F.coalesce(F.max(F.when(~F.col("__fits"), F.col("__n"))).over(so_far), F.lit(0))
    out = out.withColumn("__on", F.coalesce(begun > ended, F.lit(False)))
    return out.withColumn("merge_idx", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(so_far) - 1).drop("__n", "__fits", "__item", "__on")


def order_groups(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks (block_idx, group_id, top, block_type) by the tops of their groups' first blocks: block_idx anew, and the last header's (0 before any)."""
    first = F.min_by("top", "block_idx").over(Window.partitionBy(*keys, "group_id"))
    begin = F.min("block_idx").over(Window.partitionBy(*keys, "group_id"))
    out = blocks.withColumn("__top", first).withColumn("__begin", begin)
    order = Window.partitionBy(*keys).orderBy("__top", "__begin", "block_idx")
    out = out.withColumn("block_idx", (F.row_number().over(order) - 1).cast("int"))
    so_far = Window.partitionBy(*keys).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.coalesce(F.max(F.when(F.col("block_type") == "header", F.col("block_idx"))).over(so_far), F.lit(0))
    return out.withColumn("header_block_idx", header).drop("__top", "__begin")


def table_footers(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "table_idx")) -> DataFrame:
    """Blocks of tables with is_footer: behind the last row or aligned paragraph of their table."""
    w = Window.partitionBy(*keys)
    kept = (F.col("block_type") == "table_row") | F.coalesce(F.col("is_aligned") if "is_aligned" in blocks.columns else F.lit(False), F.lit(False))
    return blocks.withColumn("is_footer", F.col("block_idx") > F.coalesce(F.max(F.when(kept, F.col("block_idx"))).over(w), F.min("block_idx").over(w)))


def full_tables(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks (block_idx, page_idx, top, left, block_type, cell_values, is_table_start, is_table_end) as tables: keys, table_idx, the place of the first row, rows.

    Between a start and an end every block with cells counts, elsewhere only rows; a table ends with is_table_end.
    """
    w = Window.partitionBy(*keys).orderBy("block_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.max(F.when(F.col("is_table_start"), F.col("block_idx"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    closes = F.col("is_table_end") & F.col("cell_values").isNotNull()
    ended = F.coalesce(F.max(F.when(closes, F.col("block_idx"))).over(before), F.lit(-1))
    out = blocks.withColumn("__in", F.coalesce(begun > ended, F.lit(False))).withColumn("__counts", F.col("cell_values").isNotNull() & ((F.col("block_type") == "table_row") | F.col("__in")))
    out = out.filter("__counts").withColumn("table_idx", F.coalesce(F.sum(F.col("is_table_end").cast("int")).over(before), F.lit(0)))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "cell_values"))), lambda x: x["cell_values"])
    return out.groupBy(*keys, "table_idx").agg(*(F.min_by(c, "block_idx").alias(c) for c in ("page_idx", "top", "left")), rows.alias("rows"))
