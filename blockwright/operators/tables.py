"""Tables from text rows and from cells: splitting rows, runs of rows, column names, records, spans of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NUMERIC_CELL = r"^[-($%]*\d[\d.,]*[$%)]*$"
DASHES = r"^-+\$*$"


def row_cells(text: Column) -> Column:
    """The cells of a text row: numbers, yes and no, dashes and NA stand alone, words between them are one cell, a colon closes one.

    "of" after a cell that isn't words takes it back into the words; a word with a colon that follows such a cell is
    lost and leaves an empty cell, as in the reference behaviour. Empty words (double spaces) are skipped.
    """
    words = F.filter(F.split(F.replace(text, F.lit(" $ "), F.lit(" $")), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("cells"), F.lit("").alias("buffer"), F.lit("").alias("before"))

    def step(s: Column, w: Column) -> Column:
        back = (w == "of") & (F.size(s["cells"]) > 0) & (s["before"] != "str")
        cells = F.when(back, F.slice(s["cells"], F.lit(1), F.size(s["cells"]) - 1)).otherwise(s["cells"])
        buffer = F.when(back, F.concat(s["buffer"], F.element_at(s["cells"], -1))).otherwise(s["buffer"])
        kind = F.when(w.rlike(NUMERIC_CELL), "num").when(F.lower(w).isin("yes", "no"), "yes_no").when(w.rlike(DASHES), "-").when(w.isin("NA", "N/A"), "na").when(w.endswith(":"), ":").otherwise("str")
        text_before = s["before"] == "str"
        flushed = F.concat(cells, F.array(F.trim(buffer)))
        alone = kind.isin("num", "yes_no", "-", "na")
        new_cells = F.when(alone, F.concat(F.when(text_before, flushed).otherwise(cells), F.array(w))).when((kind == ":") & text_before, F.concat(cells, F.array(F.concat(F.trim(buffer), F.lit(" "), w)))).when(kind == ":", flushed).otherwise(cells)
        new_buffer = F.when(alone & ~text_before, buffer).when(alone | (kind == ":"), "").otherwise(F.concat(buffer, F.lit(" "), w))
        return F.struct(new_cells.alias("cells"), new_buffer.alias("buffer"), F.when(kind == ":", s["before"]).otherwise(kind).alias("before"))

    return F.aggregate(words, start, step, lambda s: F.when(s["buffer"] != "", F.concat(s["cells"], F.array(F.trim(s["buffer"])))).otherwise(s["cells"]))


def table_islands(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), keep_last: bool = False) -> DataFrame:
    """Blocks with table_idx of their run of at least two table rows; a single row becomes a paragraph.

    The reference behaviour never closes a document's last run, whose rows then stay rows without a table; keep_last
    treats it as any other.
    """
    w = Window.partitionBy(*keys).orderBy("block_idx")
    is_row = F.col("block_type") == "table_row"
    out = blocks.withColumn("__row", is_row).withColumn("__run", F.when(is_row, F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "__row").orderBy("block_idx"))))
    run = Window.partitionBy(*keys, "__row", "__run")
    out = out.withColumn("__n", F.count("*").over(run)).withColumn("__first", F.min("block_idx").over(run))
    last = F.max(F.when(F.col("__row"), F.col("__first"))).over(Window.partitionBy(*keys))
    closed = F.col("__row") & (F.lit(keep_last) | (F.col("__first") < last))
    out = out.withColumn("__closed", closed)
    start = F.col("__closed") & (F.col("__n") >= 2) & (F.col("block_idx") == F.col("__first"))
    number = F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    table = F.col("__closed") & (F.col("__n") >= 2)
    typed = out.withColumn("table_idx", F.when(table, number.cast("int"))).withColumn("block_type", F.when(F.col("__closed") & (F.col("__n") < 2), "para").otherwise(F.col("block_type")))
    return typed.drop("__row", "__run", "__n", "__first", "__closed")


def cells_long(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, row_idx, cell_values, col_spans, is_header...) to one row a cell of the expanded grid: key, row_idx, col_idx, value."""
    spans = F.coalesce("col_spans", F.transform("cell_values", lambda _: F.lit(1)))
    repeated = F.flatten(F.zip_with("cell_values", spans, lambda v, n: F.array_repeat(v, n)))
    return rows.select(key, "row_idx", "is_header", "is_row_group", F.posexplode(F.when(F.col("is_header"), repeated).otherwise(F.col("cell_values"))).alias("col_idx", "value"))


def column_names(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """key, col_idx and name: header levels from the top joined by a space; unnamed columns _UNKNOWN_COLUMN_i_, counted from 0."""
    cells = cells_long(rows, key)
    width = cells.filter("not is_header and not is_row_group").groupBy(key).agg((F.max("col_idx") + 1).alias("width"))
    wide = width.select(key, F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_idx"))
    named = cells.filter("is_header").groupBy(key, "col_idx").agg(F.sort_array(F.collect_list(F.struct("row_idx", F.trim("value").alias("v")))).alias("levels"))
    joined = wide.join(named, [key, "col_idx"], "left").withColumn("name", F.coalesce(F.trim(F.array_join(F.transform("levels", lambda x: x["v"]), " ")), F.lit("")))
    unknown = F.sum(F.when(F.col("name") == "", 1).otherwise(0)).over(Window.partitionBy(key).orderBy("col_idx")) - 1
    return joined.select(key, "col_idx", F.when(F.col("name") == "", F.concat(F.lit("_UNKNOWN_COLUMN_"), unknown.cast("string"), F.lit("_"))).otherwise(F.col("name")).alias("name"))


def index_choice(rows: DataFrame, key: str = "table_id", names: DataFrame | None = None) -> DataFrame:
    """key and index_col (0 the first, -1 the last, null none): by unnamed headers, numbers in either end, and years."""
    names = column_names(rows, key) if names is None else names
    body = rows.filter("not is_header and not is_row_group").select(key, F.size("cell_values").alias("w"), F.get("cell_values", F.lit(0)).alias("a"), F.element_at("cell_values", -1).alias("z"))
    last = names.groupBy(key).agg(F.max("col_idx").alias("last"), F.max_by("name", "col_idx").alias("last_name"), F.min_by("name", "col_idx").alias("first_name"))
    number = lambda c: F.regexp_replace(F.regexp_replace(c, "N/A", ""), r"[$€,%()/]", "").try_cast("double")
    ends = body.join(last, key).select(key, "last", "first_name", "last_name", number("a").alias("x"), F.when(F.col("w") == F.col("last") + 1, number("z")).alias("y"))
    stats = ends.groupBy(key, "last", "first_name", "last_name").agg(
        F.count("x").alias("n_first"),
        F.count("y").alias("n_last"),
        F.coalesce(F.bool_and(F.col("x").between(1900, 2500)), F.lit(True)).alias("years"),
    )
    unnamed = F.col("first_name").contains("_UNKNOWN_") & F.col("last_name").contains("_UNKNOWN_")
    possible = (F.col("n_first") == 0) | F.col("years")
    choice = (
        F.when(F.col("last") < 1, F.lit(None))
        .when(possible & (unnamed | ((F.col("n_first") == 0) & (F.col("n_last") > 0))), 0)
        .when(unnamed | ((F.col("n_last") == 0) & (F.col("n_first") > 0)), -1)
        .when(possible, 0)
    )
    return stats.select(key, choice.cast("int").alias("index_col"))


def table_records(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """Search records of each table: key, type (row, col, index), idx, index_text and text.

    One shuffle: the rows' groups are a window and the tables a grouping by the same key; names, index and records are
    columns over a table's rows, as a table is what a record is about.
    """
    order = Window.partitionBy(key).orderBy("row_idx")
    group = F.last(F.when(~F.col("is_header") & F.col("is_row_group"), F.trim(F.array_join("cell_values", " "))), ignorenulls=True).over(order)
    one = F.struct("row_idx", "is_header", "is_row_group", "cell_values", "col_spans", group.alias("group"))
    made = rows.select(key, one.alias("r")).groupBy(key).agg(F.sort_array(F.collect_list("r")).alias("t"))
    spread = lambda r: F.flatten(F.zip_with(r["cell_values"], F.coalesce(r["col_spans"], F.transform(r["cell_values"], lambda _: F.lit(1))), lambda v, n: F.array_repeat(v, n)))
    made = made.withColumn("heads", F.transform(F.filter("t", lambda r: r["is_header"]), spread)).withColumn("body", F.filter("t", lambda r: ~r["is_header"] & ~r["is_row_group"]))
    made = made.withColumn("width", F.coalesce(F.array_max(F.transform("body", lambda r: F.size(r["cell_values"]))), F.lit(0))).filter("width > 0")
    places = F.sequence(F.lit(0), F.col("width") - 1)
    made = made.withColumn("named", F.transform(places, lambda c: F.trim(F.array_join(F.transform("heads", lambda h: F.trim(F.get(h, c))), " "))))
    unknown = lambda c: F.size(F.filter(F.slice("named", F.lit(1), c + 1), lambda n: n == "")) - 1
    made = made.withColumn("names", F.transform("named", lambda n, c: F.when(n == "", F.concat(F.lit("_UNKNOWN_COLUMN_"), unknown(c).cast("string"), F.lit("_"))).otherwise(n)))
    made = made.withColumn("at", _index_place(F.col("body"), F.col("names"), F.col("width")))

    said = lambda c: F.trim(F.replace(c, F.lit(":"), F.lit("")))
    known = lambda c: c.isNotNull() & ~c.startswith("_UNKNOWN")
    grouped = F.size(F.array_distinct(F.transform("body", lambda r: F.coalesce(r["group"], F.lit("_UNKNOWN_INDEX_"))))) > 1
    made = made.withColumn("grouped", grouped)

    def row_record(r: Column, i: Column) -> Column:
        cells = F.filter(F.transform(r["cell_values"], lambda v, c: F.struct(c.alias("c"), F.trim(v).alias("v"))), lambda x: F.col("at").isNull() | (x["c"] != F.col("at")))
        own = F.when(F.col("at").isNotNull(), F.trim(F.get(r["cell_values"], F.col("at"))))
        parts = F.filter(F.array(F.when(F.col("grouped") & known(r["group"]), said(r["group"])), F.when(known(own), said(own))), lambda x: x.isNotNull())
        return _record("row", i, F.array_join(parts, " "), F.array_join(F.concat(parts, F.transform(cells, lambda x: x["v"])), " "))

    def column_record(c: Column, i: Column) -> Column:
        name = F.get("names", c)
        heading = F.when(known(name), said(name)).otherwise("")
        return _record("col", i, heading, F.trim(F.concat_ws(" ", heading, F.array_join(F.transform("body", lambda r: F.trim(F.get(r["cell_values"], c))), " "))))

    others = F.filter(places, lambda c: F.col("at").isNull() | (c != F.col("at")))
    name = F.get("names", F.col("at"))
    index = F.when(F.col("at").isNotNull() & known(name), F.array(_record("index", F.lit(0), name, name))).otherwise(F.array().cast("array<struct<type:string,idx:int,index_text:string,text:string>>"))
    records = F.concat(F.transform("body", row_record), F.transform(others, column_record), index)
    return made.select(key, F.explode(records).alias("r")).select(key, "r.type", "r.idx", "r.index_text", "r.text")


def _record(kind: str, i: Column, index_text: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), i.cast("int").alias("idx"), index_text.alias("index_text"), text.alias("text"))


def _index_place(body: Column, names: Column, width: Column) -> Column:
    """The place of the index column among the cells of a table's rows, as index_choice() has it; null for none."""
    number = lambda c: F.regexp_replace(F.regexp_replace(c, "N/A", ""), r"[$€,%()/]", "").try_cast("double")
    first = F.filter(F.transform(body, lambda r: number(F.get(r["cell_values"], F.lit(0)))), lambda x: x.isNotNull())
    last = F.filter(F.transform(body, lambda r: F.when(F.size(r["cell_values"]) == width, number(F.element_at(r["cell_values"], -1)))), lambda x: x.isNotNull())
    unnamed = F.get(names, F.lit(0)).contains("_UNKNOWN_") & F.element_at(names, -1).contains("_UNKNOWN_")
    possible = (F.size(first) == 0) | F.forall(first, lambda x: x.between(1900, 2500))
    return (
        F.when(width < 2, F.lit(None).cast("int"))
        .when(possible & (unnamed | ((F.size(first) == 0) & (F.size(last) > 0))), 0)
        .when(unnamed | ((F.size(last) == 0) & (F.size(first) > 0)), width - 1)
        .when(possible, 0)
    )


def column_spans(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unions of overlapping x-intervals (left, right) of each table: keys, span_idx, span_left, span_right. A running maximum finds the gaps."""
    order = Window.partitionBy(*keys).orderBy("left", "right")
    reach = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = boxes.withColumn("__new", F.when(reach.isNull() | (F.col("left") > reach), 1).otherwise(0))
    numbered = marked.withColumn("span_idx", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return numbered.groupBy(*keys, "span_idx").agg(F.min("left").alias("span_left"), F.max("right").alias("span_right"))


def grid(boxes: DataFrame, keys: Sequence[str], row: str = "row_idx", text: str = "text") -> DataFrame:
    """Cells put into the spans of their table: keys, row, span_idx and the texts that fall into it from the left."""
    spans = column_spans(boxes, keys)
    inside = boxes.join(spans, list(keys)).filter((F.col("left") >= F.col("span_left")) & (F.col("right") <= F.col("span_right")))
    return inside.groupBy(*keys, row, "span_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", F.col(text).alias("t")))), lambda x: x["t"]), " ").alias("cell"))


def positioned_table(cells: DataFrame, keys: Sequence[str] = ("doc_id", "table_idx"), first_rows: int = 5) -> DataFrame:
    """Positioned cells (keys, row_idx, left, right, text) to rows: keys, row_idx, cell_values, col_spans, is_header, is_row_group.

    The header is the first row with at most one column fewer than the widest of the first rows. Its cells are the
    columns, each reaching to the middle of the gap to the next; other cells belong to the column that they overlap
    most, and a wide one also spans those that lie wholly below it. A row of one cell over several columns is a group.
    """
    row = [*keys, "row_idx"]
    per_row = column_spans(cells, row).groupBy(*row).agg(F.count("*").alias("n_cols"))
    place = Window.partitionBy(*keys).orderBy("row_idx")
    ranked = per_row.withColumn("__n", F.row_number().over(place)).withColumn("__most", F.max(F.when(F.col("__n") <= first_rows, F.col("n_cols"))).over(Window.partitionBy(*keys)))
    heads = ranked.filter(F.col("n_cols") >= F.col("__most") - 1).groupBy(*keys).agg(F.min("row_idx").alias("header_row"), F.min_by("n_cols", "row_idx").alias("n_head"))
    over = column_spans(cells.join(heads, list(keys)).filter(F.col("row_idx") == F.col("header_row")).select(*keys, "left", "right"), keys)
    order = Window.partitionBy(*keys).orderBy("span_left")
    edges = over.select(
        *keys,
        "span_idx",
        F.coalesce((F.lag("span_right").over(order) + F.col("span_left")) / 2, F.lit(float("-inf"))).alias("from"),
        F.coalesce((F.lead("span_left").over(order) + F.col("span_right")) / 2, F.lit(float("inf"))).alias("to"),
    )
    columns = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("span_idx", "from", "to"))).alias("columns"))  # as many as a table has columns
    shared = lambda s: F.least(F.col("right"), s["to"]) - F.greatest(F.col("left"), s["from"])
    best = F.array_max(F.transform("columns", lambda s: F.struct(shared(s).alias("shared"), (-s["span_idx"]).alias("minus"))))
    below = F.size(F.filter("columns", lambda s: (s["from"] >= F.col("left")) & (s["to"] <= F.col("right"))))
    placed = cells.join(columns, list(keys)).withColumn("__best", best).withColumn("__below", below)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"])
    grouped = placed.withColumn("span_idx", -F.col("__best.minus")).groupBy(*row, "span_idx").agg(F.array_join(texts, " ").alias("cell"), F.max(F.greatest("__below", F.lit(1))).alias("span"))
    by_row = grouped.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("span_idx", F.struct("cell", "span")))).alias("m"), F.count("*").alias("n"))
    out = by_row.join(columns, list(keys)).join(heads, list(keys))
    values = F.transform("columns", lambda s: F.coalesce(F.try_element_at("m", s["span_idx"])["cell"], F.lit("")))
    spans = F.transform("columns", lambda s: F.coalesce(F.try_element_at("m", s["span_idx"])["span"], F.lit(1)))
    header = (F.col("row_idx") <= F.col("header_row")) & (F.col("n_head") > 1)
    return out.select(*row, values.alias("cell_values"), spans.cast("array<int>").alias("col_spans"), header.alias("is_header"), (~header & (F.col("n") == 1) & (F.size("columns") > 1)).alias("is_row_group"))


def merge_wrapped_rows(rows: DataFrame, key: Sequence[str] = ("doc_id", "table_idx")) -> DataFrame:
    """Rows (row_idx, cell_values, is_header) of two-column tables with an empty first cell go on in the row above; has_merged_cells marks rows made of several."""
    w = Window.partitionBy(*key).orderBy("row_idx")
    wrapped = (F.size("cell_values") == 2) & (F.get("cell_values", F.lit(0)) == "") & ~F.col("is_header") & ~F.coalesce(F.lag("is_header").over(w), F.lit(True))
    out = rows.withColumn("__on", wrapped).withColumn("__run", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("row_idx", F.element_at("cell_values", -1).alias("v")))), lambda x: x["v"])
    grouped = out.groupBy(*key, "__run").agg(F.min("row_idx").alias("row_idx"), F.min_by("cell_values", "row_idx").alias("cells"), F.min_by("is_header", "row_idx").alias("is_header"), parts.alias("parts"))
    merged = F.size("parts") > 1
    values = F.when(merged, F.array(F.get("cells", F.lit(0)), F.array_join("parts", " "))).otherwise(F.col("cells"))
    return grouped.select(*key, "row_idx", values.alias("cell_values"), "is_header", merged.alias("has_merged_cells"))


def html_table(cells: Column, css_class: str = "content_table") -> Column:
    """Rows of cells as an HTML table of a class."""
    rows = F.transform(cells, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>")))
    return F.concat(F.lit(f"<table class='{css_class}'>"), F.array_join(rows, ""), F.lit("</table>"))
