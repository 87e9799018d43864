"""Queries over cells, boxes and the spacing of lines, made of the items of orders; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import geometry, lines, pages, spacing, tables
from ..operators.features import with_features
from . import line_sql
from .structure_queries import _ITEMS, _items
from .tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- cells of rows ----------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items as cells, three to a row that wobbles by a point or two: doc_id and cells."""
    n = F.col("n") - 1
    top = F.lit(100.0) + F.floor(n / 3) * 14 + F.col("l_suppkey") % 5
    left = n % 3 * 120.0 + F.col("l_partkey") % 40
    cell = F.struct(top.cast("double").alias("top"), left.cast("double").alias("left"), (left + 20 + F.col("l_quantity").cast("double")).alias("right"), F.lit(10.0).alias("height"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("text"))
    return _items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n", cell.alias("c")))).alias("x")).select("doc_id", F.col("x.c").alias("cells"))


_CELLS = (
    f"{_ITEMS}, c AS (SELECT l_orderkey AS doc_id, n, 100.0::DOUBLE + (n - 1) // 3 * 14 + l_suppkey % 5 AS top, ((n - 1) % 3 * 120 + l_partkey % 40)::DOUBLE AS l, 'c' || l_linenumber AS text, ((n - 1) % 3 * 120 + l_partkey % 40)::DOUBLE + 20 + l_quantity::DOUBLE AS r FROM it),"
    " p AS (SELECT *, lag(top) OVER w AS pt, lag(r) OVER w AS pr, first_value(top) OVER w AS ft FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n)),"
    " s AS (SELECT *, n = 1 OR abs(top - pt) / (top + 5) < 0.005 OR abs(top - pt) < 2.5 AS same, n > 1 AND (abs(top - ft) / (top + 5) < 0.005 OR abs(top - ft) < 2.5) AS as_first, CASE WHEN n > 1 THEN round_even(l - pr, 1) END AS gap FROM p)"
)


@query(
    f"WITH {_CELLS}, m AS (SELECT doc_id, min(gap) AS least FROM s GROUP BY doc_id) SELECT doc_id, coalesce(min(n) FILTER (NOT same) - 1, count(*))::INTEGER AS columns, coalesce(min(n) FILTER (as_first) - 1, max(n) - 1)::INTEGER AS same_top, (count(*) FILTER (NOT same))::INTEGER AS rows_changed,"
    " round(coalesce(avg(top - pt - 10) FILTER (NOT same AND pt < top), 0), 6) AS space, (count(*) FILTER (gap > 3 * least))::INTEGER AS wide, coalesce(min(gap) FILTER (gap > 3 * least), 0)::DOUBLE AS threshold, (count(*) FILTER (gap > 60))::INTEGER AS possible FROM s JOIN m USING (doc_id) GROUP BY doc_id"
)
def row_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, found = F.col("cells"), geometry.wide_gaps(geometry.gaps(F.col("cells")))
    return _cells(spark, sf_dir).select(
        "doc_id",
        geometry.column_count(c).alias("columns"),
        geometry.first_same_top(c).alias("same_top"),
        geometry.row_changes(c).alias("rows_changed"),
        F.round(geometry.mean_row_space(c), 6).alias("space"),
        found["n"].alias("wide"),
        found["threshold"].alias("threshold"),
        geometry.possible_cells(c, F.lit(60.0), F.lit(False)).alias("possible"),
    )


@query(
    f"WITH {_CELLS}, g AS (SELECT *, sum(CASE WHEN n > 1 AND round_even(l - pr, 0) >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run, count(*) OVER (PARTITION BY doc_id) AS k FROM s)"
    " SELECT doc_id, run::INTEGER AS part, string_agg(text, ' ' ORDER BY n) AS text, arg_min(l, n) AS begins, arg_max(r, n) AS ends, arg_min(l, n) + (arg_max(r, n) - arg_min(l, n)) / 2 AS center FROM g WHERE k > 1 GROUP BY doc_id, run"
)
def cells_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _cells(spark, sf_dir).select("doc_id", F.posexplode(geometry.cells_by_gap(F.col("cells"), F.lit(60))).alias("part", "m"))
    return made.select("doc_id", "part", "m.text", F.col("m.left").alias("begins"), F.col("m.right").alias("ends"), "m.center")


_PAIRS = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 100)::DOUBLE AS a0, (l_partkey % 100)::DOUBLE + l_quantity::DOUBLE AS a1, (l_suppkey % 100)::DOUBLE AS b0, (l_suppkey % 100)::DOUBLE + l_linenumber * 10 - 10 AS b1 FROM lineitem)"


@query(
    f"WITH {_PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN b1 = b0 THEN 0 WHEN a0 <= b0 AND b1 <= a1 THEN 1 WHEN a0 > b0 AND b1 <= a0 THEN 0 ELSE (b1 - a0) / abs(b1 - b0) END, 6) AS from_top,"
    " round(CASE WHEN a0 = b0 AND a1 <> a0 THEN (b1 - b0) / (a1 - a0) ELSE 1 END, 6) AS below, abs(a0 - b0) < 0.2 AS nearly_left, a0 + 10 >= 30 AND a0 + 10 <= 60 AS middle,"
    " a0 >= 20 AND a0 <= 90 AND b0 BETWEEN 10 AND 60 AS begins_in, a0 >= 30 AND a0 <= 80 AND b0 BETWEEN 10 AND 60 AND a0 + 10 <= 80 AND b1 <= 60 AS lies_in FROM b"
)
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a0, b0 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    a1, b1 = a0 + F.col("l_quantity").cast("double"), b0 + F.col("l_linenumber") * 10 - 10
    bound = F.struct(F.lit(10.0).alias("left"), F.lit(30.0).alias("top"), F.lit(60.0).alias("right"), F.lit(80.0).alias("bottom"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(geometry.overlap_from_top(a0, a1, b0, b1), 6).alias("from_top"),
        F.round(geometry.overlap_below(a0, a1, b0, b1), 6).alias("below"),
        geometry.nearly_left(a0, b0).alias("nearly_left"),
        geometry.in_middle_third(a0, F.lit(10.0), F.lit(90.0)).alias("middle"),
        geometry.within(a0, b0, F.lit(10.0), bound).alias("begins_in"),
        geometry.whole_within(a0, b0, b1, F.lit(10.0), bound).alias("lies_in"),
    )


# ---- blocks of pages --------------------------------------------------------------------------------------------------


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("para", "header", "list_item", "table_row"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return _items(spark, sf_dir).select(
        (F.col("l_orderkey") % 400).alias("doc_id"),
        F.lit(0).alias("page_idx"),
        (F.col("l_orderkey") * 10 + F.col("n")).alias("block_idx"),
        (F.col("l_orderkey") % 7).alias("group_id"),
        (F.col("l_partkey") % 700).cast("double").alias("top"),
        (F.col("l_suppkey") % 9 * 12).cast("double").alias("left"),
        kind.alias("block_type"),
        F.when(F.col("l_partkey") % 3 == 0, "It ends.").otherwise("It goes on").alias("block_text"),
        F.lit(12.0).alias("font_size"),
    )


_PLACED = f"{_ITEMS}, b AS (SELECT l_orderkey % 400 AS doc_id, l_orderkey * 10 + n AS block_idx, l_orderkey % 7 AS group_id, (l_partkey % 700)::DOUBLE AS top, (l_suppkey % 9 * 12)::DOUBLE AS l, ['para', 'header', 'list_item', 'table_row'][(l_suppkey % 4 + 1)::INTEGER] AS block_type, l_partkey % 3 = 0 AS stops FROM it)"


@query(
    f"WITH RECURSIVE {_PLACED}, x AS (SELECT *, abs(l - lag(l) OVER (PARTITION BY doc_id ORDER BY l, top, block_idx)) >= 20 AS new FROM b), c AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY l, top, block_idx ROWS UNBOUNDED PRECEDING) AS col FROM x),"
    " t AS (SELECT *, abs(top - lag(top) OVER w) >= 35 AS apart, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY doc_id, col ORDER BY top, l, block_idx)), r AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, col ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM t),"
    " z AS (SELECT doc_id, col, run, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT doc_id, col, run, n AS held, 0 AS part FROM z WHERE run = 0 UNION ALL SELECT z.doc_id, z.col, z.run, CASE WHEN f.held > 1 THEN z.n ELSE f.held + z.n END, CASE WHEN f.held > 1 THEN f.part + 1 ELSE f.part END FROM f JOIN z ON z.doc_id = f.doc_id AND z.col = f.col AND z.run = f.run + 1)"
    " SELECT doc_id, block_idx, col::BIGINT AS col_idx, CASE WHEN max(col) OVER (PARTITION BY doc_id) > 0 THEN part END AS part FROM r JOIN f USING (doc_id, col, run)"
)
def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.column_clusters(_placed(spark, sf_dir)).select("doc_id", "block_idx", F.col("column").alias("col_idx"), "part")


@query(
    f"WITH {_PLACED}, w AS (SELECT *, lag(block_type) OVER q AS pk, lag(stops) OVER q AS ps, lag(top) OVER q AS pt, row_number() OVER q AS k FROM b WINDOW q AS (PARTITION BY doc_id, group_id ORDER BY top, block_idx)), f AS (SELECT *, coalesce(block_type = 'para' AND NOT ps AND top - pt <= 12 * 1.1, false) AS fits FROM w),"
    " j AS (SELECT *, coalesce(max(k) FILTER (fits AND pk = 'list_item') OVER u > coalesce(max(k) FILTER (NOT fits) OVER u, 0), false) AS goes FROM f WINDOW u AS (PARTITION BY doc_id, group_id ORDER BY k ROWS UNBOUNDED PRECEDING))"
    " SELECT doc_id, group_id, block_idx, (sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, group_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS merge_idx FROM j"
)
def merged_in_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.merged_in_column(_placed(spark, sf_dir), ["doc_id", "group_id"]).select("doc_id", "group_id", "block_idx", "merge_idx")


@query(
    f"WITH {_PLACED}, g AS (SELECT *, arg_min(top, block_idx) OVER (PARTITION BY doc_id, group_id) AS first, min(block_idx) OVER (PARTITION BY doc_id, group_id) AS begin FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, begin, block_idx) - 1 AS i FROM g)"
    " SELECT doc_id, block_idx AS was, i::INTEGER AS block_idx, coalesce(max(i) FILTER (block_type = 'header') OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0)::INTEGER AS header_block_idx FROM o"
)
def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = geometry.order_groups(_placed(spark, sf_dir).withColumn("was", F.col("block_idx")))
    return made.select("doc_id", "was", "block_idx", "header_block_idx")


@query(
    f"WITH {_PLACED} SELECT doc_id, group_id, block_idx, block_idx > coalesce(max(block_idx) FILTER (block_type = 'table_row') OVER w, min(block_idx) OVER w) AS is_footer FROM b WINDOW w AS (PARTITION BY doc_id, group_id)"
)
def table_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.table_footers(_placed(spark, sf_dir), ["doc_id", "group_id"]).select("doc_id", "group_id", "block_idx", "is_footer")


@query(
    f"WITH {_PLACED}, m AS (SELECT *, CASE WHEN l <> 12 THEN [block_type, block_idx::VARCHAR] END AS cells, block_idx % 11 = 0 AS opens, block_idx % 5 = 0 AS shuts FROM b),"
    " s AS (SELECT *, coalesce(max(block_idx) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) > coalesce(max(block_idx) FILTER (shuts AND cells IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS within FROM m),"
    " k AS (SELECT *, coalesce(sum(shuts::INTEGER) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM s WHERE cells IS NOT NULL AND (block_type = 'table_row' OR within))"
    " SELECT doc_id, t::BIGINT AS table_idx, arg_min(top, block_idx) AS top, arg_min(l, block_idx) AS begins, string_agg(array_to_string(cells, '|'), ';' ORDER BY block_idx) AS rows FROM k GROUP BY doc_id, t"
)
def full_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("block_idx")
    marked = _placed(spark, sf_dir).withColumns({"cell_values": F.when(F.col("left") != 12, F.array("block_type", i.cast("string"))), "is_table_start": i % 11 == 0, "is_table_end": i % 5 == 0})
    made = geometry.full_tables(marked)
    return made.select("doc_id", "table_idx", "top", F.col("left").alias("begins"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


# ---- spacing of lines -------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as lines of pages."""
    place = Window.partitionBy("doc_id", "page_idx").orderBy("l_orderkey", "n")
    items = _items(spark, sf_dir).withColumn("doc_id", F.col("l_orderkey") % 60).withColumn("page_idx", F.floor(F.col("l_orderkey") / 60) % 5)
    left = (F.col("l_suppkey") % 50).cast("double")
    right = left + 100 + F.col("l_quantity").cast("double") * 4
    return items.withColumn("line_no", F.row_number().over(place)).select(
        "doc_id",
        "page_idx",
        "line_no",
        F.concat(F.when(F.col("l_partkey") % 2 == 0, "Total: ").otherwise("of "), F.col("l_linenumber").cast("string")).alias("text"),
        left.alias("left"),
        right.alias("right"),
        (F.col("line_no") * 12.0 + F.col("l_partkey") % 3 * 2).alias("top"),
        (F.lit(8.0) + F.when(F.col("l_partkey") % 31 == 0, 12).otherwise(F.col("l_partkey") % 4)).alias("font_size"),
        F.when(F.col("l_suppkey") % 11 == 0, 700.0).otherwise(400.0).alias("font_weight"),
        F.array(left, left + 60).alias("starts"),
        F.array(left + 30 + F.col("l_linenumber") * 3, right).alias("ends"),
        F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("texts"),
    )


_LINES = (
    f"{_ITEMS}, li AS (SELECT *, l_orderkey % 60 AS doc_id, (l_orderkey // 60) % 5 AS page_idx, row_number() OVER (PARTITION BY l_orderkey % 60, (l_orderkey // 60) % 5 ORDER BY l_orderkey, n) AS line_no FROM it),"
    " ln AS (SELECT doc_id, page_idx, line_no, CASE WHEN l_partkey % 2 = 0 THEN 'Total: ' ELSE 'of ' END || l_linenumber AS text, (l_suppkey % 50)::DOUBLE AS l, (l_suppkey % 50)::DOUBLE + 100 + l_quantity::DOUBLE * 4 AS r, line_no * 12.0::DOUBLE + l_partkey % 3 * 2 AS top,"
    " 8.0::DOUBLE + CASE WHEN l_partkey % 31 = 0 THEN 12 ELSE l_partkey % 4 END AS size, CASE WHEN l_suppkey % 11 = 0 THEN 700.0 ELSE 400.0 END::DOUBLE AS weight, (l_suppkey % 50)::DOUBLE + 60 - ((l_suppkey % 50)::DOUBLE + 30 + l_linenumber * 3) > 20 AS tab, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 2 END AS parts FROM li),"
    " st AS (SELECT *, coalesce(round_even(top - lag(top) OVER w, 0), -1) AS before, coalesce(round_even(lead(top) OVER w - top, 0), -1) AS after, tab::INTEGER AS tabs, (floor((r - l)::INTEGER / 10) * 10)::INTEGER AS len FROM ln WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_no)),"
    " fs AS (SELECT doc_id, page_idx, size, count(*) AS k, min(line_no) AS f FROM st GROUP BY ALL), fw AS (SELECT doc_id, page_idx, weight, count(*) AS k, min(line_no) AS f FROM st GROUP BY ALL), fl AS (SELECT doc_id, page_idx, len, count(*) AS k, min(line_no) AS f FROM st GROUP BY ALL),"
    " pg AS (SELECT * FROM (SELECT doc_id, page_idx, count(*) AS n_lines, median(size) AS median_size, count(DISTINCT size) AS sizes, max(size) AS largest FROM st GROUP BY ALL) JOIN (SELECT doc_id, page_idx, arg_max(size, (k, -f)) AS mode_size FROM fs GROUP BY ALL) USING (doc_id, page_idx)"
    " JOIN (SELECT doc_id, page_idx, arg_max(weight, (k, -f)) AS mode_weight FROM fw GROUP BY ALL) USING (doc_id, page_idx) JOIN (SELECT doc_id, page_idx, arg_max(len, (k, -f)) AS mode_len FROM fl GROUP BY ALL) USING (doc_id, page_idx))"
)


@query(f"WITH {_LINES} SELECT doc_id, page_idx, n_lines, median_size, sizes, largest, mode_size, mode_weight, mode_len FROM pg")
def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spacing.page_stats(spacing.line_steps(_lines(spark, sf_dir)))
    return made.select("doc_id", "page_idx", "n_lines", "median_size", "sizes", "largest", F.col("mode_font_size").alias("mode_size"), F.col("mode_font_weight").alias("mode_weight"), F.col("mode_rounded_length").alias("mode_len"))


@query(
    f"WITH {_LINES} SELECT doc_id, page_idx, line_no, before, after, tabs, size > mode_size * 4 / 3 AS is_large, mode_weight < 600 AND weight > 600 AS is_bold, count(*) OVER (PARTITION BY doc_id, page_idx, size, before) > 2 AS usual_before,"
    " count(*) OVER (PARTITION BY doc_id, page_idx, size, after) > 2 AS usual_after, round(count(*) OVER (PARTITION BY doc_id, page_idx, size) / n_lines, 6) AS size_share FROM st JOIN pg USING (doc_id, page_idx)"
)
def line_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spacing.looks(spacing.line_steps(_lines(spark, sf_dir)))
    return made.select("doc_id", "page_idx", "line_no", F.col("step_before").alias("before"), F.col("step_after").alias("after"), "tabs", "is_large", "is_bold", "usual_before", "usual_after", F.round("size_share", 6).alias("size_share"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with p and c, the line before and their own values."""
    made = spacing.looks(spacing.line_steps(_lines(spark, sf_dir)))
    now = F.struct("left", "right", "top", "font_size", "font_weight", "starts", "texts", "tabs", "text", F.lit("para").alias("line_type"), F.lit(False).alias("incomplete_line"))
    order = Window.partitionBy("doc_id", "page_idx").orderBy("line_no")
    return made.withColumn("c", now).withColumn("p", F.lag("c").over(order)).withColumn("next_size", F.lead("font_size").over(order))


@query(
    f"WITH {_LINES}, sh AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_idx, size) / n_lines AS share, round_even(size - round_even(median_size, 0), 0) AS up, lag(l) OVER w AS pl, lag(r) OVER w AS pr, lag(top) OVER w AS pt, lag(size) OVER w AS ps, lag(weight) OVER w AS pw, lag(tabs) OVER w AS ptabs, lag(parts) OVER w AS pp, lag(text) OVER w AS px, lead(size) OVER w AS ns FROM st JOIN pg USING (doc_id, page_idx) WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_no)),"
    " nx AS (SELECT *, CASE WHEN round_even(ns - round_even(median_size, 0), 0) = 0 THEN 0.8 ELSE round_even(ns - round_even(median_size, 0), 0) END AS nup, (pr - pl - CASE WHEN pl <= l THEN l - pl ELSE 0 END) / (r - l) AS over, pw <> weight OR ps > size AS restyled, pp > 1 AND abs(pp - parts) <= 1 AND abs(round_even(pl, 0) - round_even(l, 0)) <= 100 AS aligned FROM sh)"
    " SELECT doc_id, page_idx, line_no, coalesce(sizes >= 4 AND share <= 0.08 AND ((round_even(largest, 0) - size) / round_even(largest, 0) < 0.2 OR up / nup > 2) AND up > 1 AND (up - nup > 0.3 OR size = ns), false) AS rare,"
    " coalesce(pt < top AND NOT (round_even(pl, 0) = round_even(l, 0) AND round_even(pr - pl, 0) = round_even(r - l, 0)) AND (over < 0.3 OR (restyled AND over < 0.6)), false) AS narrow, coalesce(aligned, false) AS aligned,"
    " coalesce((ptabs = tabs AND tabs > 0 AND pp = parts AND pp >= 2) OR (contains(px, ':') AND contains(text, ':') AND px[1] = text[1]) OR (aligned AND pp = parts AND pp >= 2 AND (ptabs > 0 OR tabs > 0)), false) AS goes_on,"
    " coalesce(least(pr::INTEGER, r::INTEGER) > greatest(pl::INTEGER, l::INTEGER) AND NOT pt < top, false) AS misplaced, coalesce(pt >= top AND pl <= l AND pt - ps < top + size, false) AS key_value FROM nx"
)
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = F.col("p"), F.col("c")
    aligned = spacing.parts_aligned(p, c)
    tests = {
        "rare": spacing.rare_font_header(F.col("font_size"), F.col("next_size"), F.col("size_share"), F.col("median_size"), F.col("largest"), F.col("sizes")),
        "narrow": spacing.narrow_header(p, c),
        "aligned": aligned,
        "goes_on": spacing.row_goes_on(p, c, aligned),
        "misplaced": spacing.misplaced(p, c),
        "key_value": spacing.key_value(p, c),
    }
    return _paired(spark, sf_dir).select("doc_id", "page_idx", "line_no", *(F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()))


@query(
    f"WITH {_LINES}, cn AS (SELECT doc_id, page_idx, size, before, count(*) AS n FROM st GROUP BY ALL), lo AS (SELECT doc_id, page_idx, size, min(before) AS least FROM cn WHERE before > 0 AND n > 2 GROUP BY ALL)"
    " SELECT s.doc_id, s.page_idx, s.line_no, coalesce(s.before >= 0 AND abs(s.before - least) <= 1 AND (EXISTS (SELECT 1 FROM cn WHERE cn.doc_id = s.doc_id AND cn.page_idx = s.page_idx AND cn.size = s.size AND abs(cn.before - s.before) = 1)"
    " OR EXISTS (SELECT 1 FROM cn WHERE cn.doc_id = s.doc_id AND cn.page_idx = s.page_idx AND cn.size = s.size AND cn.before = s.before AND cn.n > 3)), false) AS joins_by_step FROM st s LEFT JOIN lo ON lo.doc_id = s.doc_id AND lo.page_idx = s.page_idx AND lo.size = s.size"
)
def usual_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spacing.usual_step(spacing.line_steps(_lines(spark, sf_dir))).select("doc_id", "page_idx", "line_no", "joins_by_step")


# ---- texts ------------------------------------------------------------------------------------------------------------

_TYPED = f"WITH {line_sql.lines()}, {line_sql.features()}"


@query(
    f"{_TYPED}, o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, line, line_type, incomplete_line, continuing_line FROM typed), w AS (SELECT *, i // 5 AS page, lag(line_type) OVER q AS pk, lag(incomplete_line) OVER q AS pi FROM o WINDOW q AS (PARTITION BY doc_id ORDER BY i)),"
    " j AS (SELECT *, coalesce(i % 5 = 0 AND i > 0 AND line_type = 'para' AND pk = 'para' AND (pi OR continuing_line), false) AS goes FROM w), r AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS run FROM j)"
    " SELECT doc_id, run::INTEGER AS block_idx, arg_min(page, i)::INTEGER AS page_idx, arg_min(line_type, i) AS block_type, string_agg(line, ' ' ORDER BY i) AS block_text FROM r GROUP BY doc_id, run"
)
def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, five to a page."""
    typed = with_features(lines.exploded(table(spark, sf_dir, "documents")))
    made = typed.select("doc_id", F.floor(F.col("line_no") / 5).cast("int").alias("page_idx"), F.col("line_no").alias("block_idx"), F.col("line_type").alias("block_type"), F.col("text").alias("block_text"))
    return spacing.joined_pages(made).select("doc_id", "block_idx", "page_idx", "block_type", "block_text")


_BARE = "list_filter(list_transform(string_split({}, ' '), lambda x: regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')), lambda x: x <> '')"


@query(
    f"WITH {line_sql.lines()}, v AS (SELECT doc_id, n, line, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM lines), x AS (SELECT *, {_BARE.format('line')} AS a, {_BARE.format("coalesce(p, '')")} AS b, string_split(line, ' ') AS ws FROM v)"
    " SELECT doc_id, n::INTEGER AS line_no, nullif(regexp_extract(line, '\\$?(\\d*(\\d\\.?|\\.\\d{1,2}))$', 0), '') AS number, floor(list_sum(list_transform(ws, lambda w: length(regexp_replace(w, '\\s+', '', 'g')))) / len(ws)) <= 2 AS short,"
    " CASE WHEN len(a) = 0 OR len(b) = 0 THEN len(a) = len(b) ELSE list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda o: o = w)), len(list_filter(b, lambda o: o = w))))) / greatest(len(a), len(b)) >= 0.8 END AS same,"
    " NOT regexp_matches(right(line, 1), '^[\\p{L}\\p{N}_-]') AS boundary, replace(replace(line, 'th', '*'), 'e*', '*') AS replaced FROM x"
)
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.split_lines(table(spark, sf_dir, "documents"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    words: Column = F.split("line", " ")
    out = found.withColumn("p", F.coalesce(before, F.lit("")))
    return out.select(
        "doc_id",
        "line_no",
        scalars.trailing_number(F.col("line")).alias("number"),
        scalars.short_words(words).alias("short"),
        scalars.same_words(words, F.split("p", " ")).alias("same"),
        scalars.word_boundary(F.right("line", F.lit(1))).alias("boundary"),
        scalars.replaced(scalars.replaced(F.col("line"), ["th"], "*"), ["e*"], "*").alias("replaced"),
    )


_ROMAN = "[{}]".format(", ".join(f"'{r}'" for r in "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()))


@query(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, marker, CASE l_suppkey % 4 WHEN 0 THEN l_partkey % 20 + 1 WHEN 1 THEN l_partkey % 60 + 1 WHEN 2 THEN (l_partkey % 9 + 1) * 100 + l_linenumber ELSE 97 + [0, 1, 3, 4][(l_partkey % 4 + 1)::INTEGER] END::BIGINT AS ordinal"
    f" FROM (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN '(' || {_ROMAN}[(l_partkey % 20 + 1)::INTEGER] || ')' WHEN 1 THEN (l_partkey % 60 + 1) || '.' WHEN 2 THEN (l_partkey % 9 + 1) || '.' || l_linenumber ELSE ['a', 'b', 'd', 'e'][(l_partkey % 4 + 1)::INTEGER] || ')' END AS marker FROM lineitem)"
)
def marker_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of lists made of items: roman numerals, integers, sections of two parts, letters."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    of = lambda words, at: F.element_at(F.array(*map(F.lit, words.split())), (at + 1).cast("int"))
    roman = F.concat(F.lit("("), of("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx", part % 20), F.lit(")"))
    integer, section = F.concat((part % 60 + 1).cast("string"), F.lit(".")), F.concat((part % 9 + 1).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    letter = F.concat(of("a b d e", part % 4), F.lit(")"))
    marker = F.when(supp % 4 == 0, roman).when(supp % 4 == 1, integer).when(supp % 4 == 2, section).otherwise(letter)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", marker.alias("marker")).withColumn("ordinal", scalars.marker_ordinal(F.col("marker")))


@query(
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,8}')) AS w FROM documents), n AS (SELECT w, unnest([w || '_' || reverse(w), upper(w[1]) || w[2:] || upper(w[3]) || w[4:] || 'Xml', upper(w[1]) || w[2:] || 'XML', w]) AS name FROM w WHERE w ~ '^[a-z]+$' AND length(w) > 3)"
    " SELECT DISTINCT name, CASE WHEN contains(name, '_') THEN array_to_string(list_transform(string_split(name, '_'), lambda x: upper(x[1]) || x[2:]), ' ') WHEN regexp_matches(name, '^[a-z]+$') THEN upper(name[1]) || name[2:]"
    " ELSE array_to_string(list_transform(regexp_extract_all(name, '[A-Z][a-z]+|[A-Z]+'), lambda x: x[1] || lower(x[2:])), ' ') END AS header FROM n"
)
def readable_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of the words of all documents: in snake case, in camel case, with capitals at the end, plain."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,8}"), F.lit(0))).alias("w")).distinct().filter("length(w) > 3")
    w = F.col("w")
    head = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 8))
    camel = F.concat(head, F.upper(F.substring(w, 3, 1)), F.substring(w, 4, 8), F.lit("Xml"))
    names = words.select(F.explode(F.array(F.concat(w, F.lit("_"), F.reverse(w)), camel, F.concat(head, F.lit("XML")), w)).alias("name")).distinct()
    return names.select("name", scalars.make_header(F.col("name")).alias("header"))


@query(
    f"WITH {_ITEMS}, g AS (SELECT l_orderkey AS t, l_orderkey % 4 AS kind, bool_and(l_partkey % 3000 BETWEEN 1900 AND 2500) AS years FROM it GROUP BY l_orderkey)"
    " SELECT t AS table_id, CASE kind WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN CASE WHEN years THEN 0 END ELSE 0 END::INTEGER AS index_col FROM g"
)
def index_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with words in the first column, in the last one, numbers in both, and words in both."""
    items, kind = _items(spark, sf_dir), F.col("l_orderkey") % 4
    word, number, end = F.concat(F.lit("part "), F.col("l_partkey").cast("string")), (F.col("l_partkey") % 3000).cast("string"), F.col("l_quantity").cast("long").cast("string")
    cells = F.when(kind == 0, F.array(word, number, end)).when(kind == 1, F.array(end, number, word)).when(kind == 2, F.array(number, word, end)).otherwise(F.array(word, number, F.concat(word, F.lit(" b"))))
    body = items.select(F.col("l_orderkey").alias("table_id"), F.col("n").alias("row_idx"), F.lit(False).alias("is_header"), cells.alias("cell_values"))
    head = items.select(F.col("l_orderkey").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_idx"), F.lit(True).alias("is_header"), F.array(F.lit("First"), F.lit("Second"), F.lit("Third")).alias("cell_values"))
    made = head.unionByName(body).withColumn("is_row_group", F.lit(False)).withColumn("col_spans", F.lit(None).cast("array<int>"))
    return tables.index_choice(made)


# ---- pages ------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_LINES}, ig AS (SELECT doc_id, page_idx, line_no, floor((line_no - 1) / 3) * 12 AS t, ((line_no - 1) % 3 * 100)::DOUBLE + l AS a, ((line_no - 1) % 3 * 100)::DOUBLE + l + 70 AS z, text, tabs = 1 AND line_no % 4 > 0 AS ig, line_no % 9 = 0 AS mark FROM st),"
    " nb AS (SELECT *, max(line_no) FILTER (NOT ig) OVER (PARTITION BY doc_id, page_idx ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_kept, lag(t) OVER w AS pt, lag(z) OVER w AS pz FROM ig WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_no)),"
    " ad AS (SELECT n.*, coalesce(n.ig AND NOT n.mark AND abs(n.t - k.t) <= 10 AND abs(k.z - n.a) <= 20, false) AS f, coalesce(n.ig AND NOT n.mark AND abs(n.t - n.pt) <= 10 AND abs(n.pz - n.a) <= 20, false) AS x FROM nb n LEFT JOIN ig k ON k.doc_id = n.doc_id AND k.page_idx = n.page_idx AND k.line_no = n.last_kept),"
    " ru AS (SELECT *, max(line_no) FILTER (f) OVER u AS b, coalesce(max(line_no) FILTER (NOT f AND NOT x) OVER u, 0) AS e FROM ad WINDOW u AS (PARTITION BY doc_id, page_idx ORDER BY line_no ROWS UNBOUNDED PRECEDING)) SELECT doc_id, page_idx, line_no, ig AND NOT (f OR (x AND coalesce(b > e, false))) AS ignored FROM ru"
)
def retained_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines to a row; some are ignored, and some of these are a mark alone."""
    n = F.col("line_no") - 1
    left = n % 3 * 100.0 + F.col("left")
    made = spacing.line_steps(_lines(spark, sf_dir)).select("doc_id", "page_idx", "line_no", (F.floor(n / 3) * 12.0).alias("top"), left.alias("left"), (left + 70).alias("right"), F.lit(10.0).alias("height"), F.when(F.col("line_no") % 9 == 0, "-").otherwise(F.col("text")).alias("text"), ((F.col("tabs") == 1) & (F.col("line_no") % 4 > 0)).alias("ignored"))
    return pages.retained(made).select("doc_id", "page_idx", "line_no", "ignored")


_FRAMES = "fr AS (SELECT l_orderkey % 400 AS doc_id, (l_partkey % 500)::DOUBLE AS t, (l_partkey % 500)::DOUBLE + 40 AS b, (l_suppkey % 60)::DOUBLE AS a, (l_suppkey % 60)::DOUBLE + 30 AS z FROM lineitem WHERE l_linenumber = 1)"


@query(f"WITH {_PLACED}, {_FRAMES} SELECT doc_id, block_idx FROM b SEMI JOIN fr ON b.doc_id = fr.doc_id AND b.top BETWEEN fr.t - 9 AND fr.b + 9 AND b.l BETWEEN fr.a AND fr.z")
def blocks_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, left = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 60).cast("double")
    box = F.struct(left.alias("left"), top.alias("top"), (left + 30).alias("right"), (top + 40).alias("bottom"))
    boxes = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select((F.col("l_orderkey") % 400).alias("doc_id"), F.lit(0).alias("page_idx"), box.alias("box"))
    return pages.in_boxes(_placed(spark, sf_dir).withColumn("height", F.lit(9.0)), boxes).select("doc_id", "block_idx")


@query(
    f"WITH {_PLACED}, {_FRAMES}, sf AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, a, b, z) AS stray_idx FROM fr), m AS (SELECT *, lag(top) OVER (PARTITION BY doc_id ORDER BY block_idx) AS p FROM b)"
    " SELECT s.doc_id, s.stray_idx, min(m.block_idx) FILTER ((m.top >= s.t AND (m.p IS NULL OR s.t > m.p) AND NOT (abs(m.top - s.t) < 0.1 AND m.l < s.a)) OR (m.top < s.t AND m.l > s.z AND s.b <= m.top + 50) OR (abs(m.top - s.t) < 0.1 AND m.l >= s.a)) AS before FROM sf s LEFT JOIN m ON m.doc_id = s.doc_id GROUP BY s.doc_id, s.stray_idx"
)
def placed_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, left = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 60).cast("double")
    stray = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select((F.col("l_orderkey") % 400).alias("doc_id"), F.lit(0).alias("page_idx"), top.alias("top"), left.alias("left"), (left + 30).alias("right"), (top + 40).alias("bottom"))
    stray = stray.withColumn("stray_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("top", "left", "bottom", "right")).cast("long"))
    main = _placed(spark, sf_dir).withColumn("bottom", F.col("top") + 50)
    return pages.placed(main, stray).select("doc_id", "stray_idx", "before")


@query(
    f"WITH {line_sql.lines()}, w AS (SELECT doc_id, n // 20 AS page, unnest(regexp_split_to_array(lower(regexp_replace(line, '([a-zäöüßàâçéèêëîïôùûñáíóú])([A-ZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ])', '\\1 \\2', 'g')), '\\s+')) AS word FROM lines) SELECT doc_id, word, max(page)::INTEGER AS page_idx FROM w WHERE word <> '' GROUP BY doc_id, word"
)
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty lines to a page."""
    made = lines.split_lines(table(spark, sf_dir, "documents")).select("doc_id", F.floor(F.col("line_no") / 20).cast("int").alias("page_idx"), F.col("line").alias("text"))
    return pages.page_words(made).select("doc_id", "word", "page_idx")


@query(
    f"WITH {_LINES}, p AS (SELECT doc_id, page_idx, line_no, size, [l, l + 10, l + 20 + line_no % 3, l + 30] AS ss, [l + 8 + size, l + 21 + line_no % 5, l + 28, l + 90] AS es, CASE WHEN parts = 2 THEN 1 ELSE 0 END AS sp FROM st),"
    " k AS (SELECT *, sp + list_sum(list_transform(ss, lambda s: len(list_filter(es, lambda e: abs(s + size - e) < 1.5)))) AS n FROM p) SELECT doc_id, page_idx, line_no, n >= 2 AND 4 // greatest(n::INTEGER, 1) <= 2 AS split FROM k"
)
def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, n, size = F.col("left"), F.col("line_no"), F.col("font_size")
    starts, ends = F.array(left, left + 10, left + 20 + n % 3, left + 30), F.array(left + 8 + size, left + 21 + n % 5, left + 28, left + 90)
    texts = F.array(F.lit("a"), F.lit("b"), F.when(F.size("texts") == 2, " c").otherwise("c"), F.lit("d"))
    return _lines(spark, sf_dir).select("doc_id", "page_idx", "line_no", pages.split_words(texts, starts, ends, size).alias("split"))


@query(f"WITH {_PLACED} SELECT doc_id, block_idx AS part_idx, round_even(top / 4, 0) AS row_top, row_number() OVER (PARTITION BY doc_id, round_even(top / 4, 0) ORDER BY block_idx) - 1 AS place FROM b")
def parts_by_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _placed(spark, sf_dir).select("doc_id", "page_idx", F.col("block_idx").alias("part_idx"), (F.col("top") / 4).alias("top"))
    return pages.tops(made).select("doc_id", "part_idx", "row_top", "place")
