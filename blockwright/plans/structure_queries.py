"""Queries over structure: sources, chains, rendering, tables, matching, layout, scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon, scalars, strings
from ..functions.sentences import sentences as split
from ..operators import blocks, indent, layout, lines, matching, merging, render, tables
from ..sources import html, markdown, rows, xml
from . import line_sql
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


_BLOCKS = f"WITH {line_sql.lines()}, {line_sql.features()}, {line_sql.blocks()}"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.clean_lines(table(spark, sf_dir, "documents"))


# ---- text -------------------------------------------------------------------------------------------------------


@query()
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _blocks(spark, sf_dir).select("doc_id", "block_idx", split(F.col("block_text")).alias("s"))
    return said.select("doc_id", "block_idx", F.posexplode_outer("s").alias("sent_idx", "sentence")).filter("sentence is not null")


@query(
    f"{_BLOCKS}, l AS (SELECT doc_id, block_idx, block_type, block_idx % 3 AS level FROM blocks)"
    " SELECT b.doc_id, b.block_idx, coalesce(string_agg(h.block_idx::VARCHAR, ',' ORDER BY h.block_idx DESC), '') AS chain FROM l b LEFT JOIN l h ON h.doc_id = b.doc_id AND h.block_type = 'header' AND h.block_idx < b.block_idx"
    " AND NOT EXISTS (SELECT 1 FROM l g WHERE g.doc_id = b.doc_id AND g.block_type = 'header' AND g.block_idx > h.block_idx AND g.block_idx <= b.block_idx AND g.level <= h.level) GROUP BY b.doc_id, b.block_idx"
)
def level_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    leveled = _blocks(spark, sf_dir).withColumn("level", F.col("block_idx") % 3)
    chained = blocks.level_chain(leveled)
    return chained.select("doc_id", "block_idx", F.array_join(F.transform("level_chain", lambda x: x["block_idx"].cast("string")), ",").alias("chain"))


@query(f"{_BLOCKS} SELECT doc_id, count(*) AS n_blocks, sum(length(block_text))::BIGINT AS n_chars FROM blocks WHERE block_type IN ('list_item', 'para', 'header') GROUP BY doc_id")
def running_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.page_blocks(_blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block_text")).alias("n_chars"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query(
    f"{_BLOCKS}, found AS (SELECT doc_id, string_agg(block_text, chr(10) ORDER BY block_idx) AS t FROM blocks GROUP BY doc_id),"
    f" w AS (SELECT doc_id, {_WORDS.format('text')} AS b, {_WORDS.format("coalesce(t, '')")} AS f FROM documents LEFT JOIN found USING (doc_id))"
    " SELECT doc_id, len(b) AS total_baseline_words, len(f) AS total_found_words, len(list_intersect(b, f)) AS words_found, CASE WHEN len(b) > 0 THEN round(len(list_intersect(b, f)) / len(b), 6) ELSE 0 END AS coverage,"
    " array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(f, x))), ' ') AS missing FROM w"
)
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = blocks.clean_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", "block_text"))).alias("x")).select("doc_id", F.array_join("x.block_text", "\n").alias("found"))
    got = matching.word_coverage(docs.select("doc_id", F.col("text").alias("baseline")).join(found, "doc_id", "left"))
    return got.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("total_baseline_words", "total_found_words", "words_found")), F.round("coverage", 6).alias("coverage"), F.array_join("missing_words", " ").alias("missing"))


# ---- HTML and other sources ---------------------------------------------------------------------------------------


@query(
    "SELECT page_id, (length(html) - length(replace(html, '<h1>', ''))) // 4 AS n_h1, (length(html) - length(replace(html, '<li>', ''))) // 4 AS n_li, (length(html) - length(replace(html, '<p>', ''))) // 3 - (length(html) - length(replace(html, '<style>p', ''))) // 100 AS n_p FROM pages"
)
def html_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = html.html_nodes(table(spark, sf_dir, "pages"))
    return nodes.groupBy("page_id").agg(*(F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("h1", "li", "p")))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_blocks(table(spark, sf_dir, "pages"))


@query("SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS header_text FROM pages")
def html_first_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.html_blocks(table(spark, sf_dir, "pages")).filter("block_type = 'header' and size(level_chain) = 1")
    return found.groupBy("page_id").agg(F.min_by("block_text", "block_idx").alias("header_text"))


@query(
    "WITH cells AS (SELECT c_custkey AS k, unnest([{'c': 0, 'h': 'c custkey', 'v': c_custkey::VARCHAR}, {'c': 1, 'h': 'c name', 'v': c_name}, {'c': 2, 'h': 'c nationkey', 'v': c_nationkey::VARCHAR}, {'c': 3, 'h': 'c acctbal', 'v': c_acctbal::VARCHAR}, {'c': 4, 'h': 'c mktsegment', 'v': c_mktsegment}]) AS x FROM customer),"
    " parts AS (SELECT k, x.c AS c, 0 AS sub, 'header' AS t, x.h AS txt, 1 AS level FROM cells UNION ALL SELECT k, x.c, 1, 'para', CASE WHEN length(x.v) > 2 THEN x.v ELSE '' END, 2 FROM cells"
    " UNION ALL SELECT c_custkey, -1, 0, 'header', c_name, 0 FROM customer)"
    " SELECT k AS c_custkey, row_number() OVER (PARTITION BY k ORDER BY c, sub) - 1 AS block_idx, t AS block_type, txt AS block_text, level FROM parts"
)
def loader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows.row_documents(table(spark, sf_dir, "customer"), "c_custkey", title_range=(2, 2), columns=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return made.select("c_custkey", F.col("block_idx").cast("long"), "block_type", "block_text", "level")


@query(
    "WITH xd AS (SELECT doc_id, source, lang, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND NOT regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')),"
    f" {line_sql.lines('xd', xml=True)}, {line_sql.features()}, {line_sql.blocks()}, bd AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM blocks), ty AS (SELECT doc_id, block_idx, block_text, CASE WHEN k = 1 THEN 'para' ELSE block_type END AS block_type FROM bd),"
    " hd AS (SELECT *, last_value(CASE WHEN block_type = 'header' THEN block_text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inner_header FROM ty),"
    " every AS (SELECT doc_id, 0 AS ord, -1 AS sub, 'header' AS block_type, 'Doc Title' AS block_text, 0 AS level, 'Doc Title' AS header_text FROM xd WHERE source <> '' UNION ALL SELECT doc_id, 0, 0, 'para', trim(source), 1, 'Doc Title' FROM xd WHERE source <> ''"
    " UNION ALL SELECT doc_id, 1, -1, 'header', trim('Full Text ' || lang), 0, trim('Full Text ' || lang) FROM xd UNION ALL SELECT hd.doc_id, 2, block_idx, block_type, block_text, CASE WHEN inner_header IS NOT NULL AND block_type = 'para' THEN 2 ELSE 1 END, CASE WHEN inner_header IS NOT NULL AND block_type = 'para' THEN inner_header ELSE trim('Full Text ' || lang) END FROM hd JOIN xd USING (doc_id))"
    " SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, sub) - 1)::INTEGER AS block_idx, block_type, block_text, level::INTEGER AS level, header_text FROM every"
)
def xml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as XML: a title and a textblock each."""
    docs = table(spark, sf_dir, "documents")
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    wrapped = F.concat(F.lit("<doc><doc_title>"), F.col("source"), F.lit('</doc_title><FullText lang="'), F.col("lang"), F.lit('">\n<textblock>'), escaped, F.lit("</textblock></FullText></doc>"))
    return xml.xml_blocks(docs.select("doc_id", wrapped.alias("text")))


@query(
    "WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, turn, role, array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9))), chr(10)) AS said FROM conversations),"
    " e AS (SELECT conv_id, k, 0 AS i, 'header' AS block_type, 'Turn ' || turn AS block_text, 1 AS level FROM t UNION ALL SELECT conv_id, k, 1, 'list_item', role, 2 FROM t UNION ALL SELECT conv_id, k, 2, 'para', said, 2 FROM t WHERE said <> '')"
    " SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k, i) - 1)::INTEGER AS part, (row_number() OVER (PARTITION BY conv_id ORDER BY k, i) - 1)::INTEGER AS block_idx, block_type, block_text, level::INTEGER AS level FROM e"
)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading a turn, the role as a list item, the text as a paragraph."""
    turns = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n\n- "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    docs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("t")))).alias("x")).select("conv_id", F.array_join("x.t", "\n").alias("text"))
    return markdown.markdown_blocks(docs, "conv_id").select("conv_id", "part", "block_idx", "block_type", "block_text", "level")


# ---- rendering ------------------------------------------------------------------------------------------------------


@query(
    f"{_BLOCKS} SELECT doc_id, block_idx, CASE WHEN block_type IN ('header', 'list_item') THEN block_type ELSE 'para' END AS tag, CASE block_type WHEN 'header' THEN '{render.HEADER_CLASS}' WHEN 'list_item' THEN '{render.LIST_CLASS}' WHEN 'table_row' THEN '{render.ROW_CLASS}' ELSE '{render.BODY_CLASS}' END AS block_class,"
    " 0 AS level, 0 AS page_idx FROM blocks WHERE block_text <> ''"
)
def render_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json_blocks(blocks.with_headers(_blocks(spark, sf_dir))).select("doc_id", "block_idx", "tag", "block_class", "level", "page_idx")


@query()
def render_json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_json(blocks.with_headers(_blocks(spark, sf_dir)), envelope=True)


@query()
def render_html_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_html(blocks.with_headers(_blocks(spark, sf_dir)))


@query()
def render_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_html(html.html_blocks(table(spark, sf_dir, "pages")), ["page_id"])


# ---- tables -----------------------------------------------------------------------------------------------------------


@query(
    f"{_BLOCKS}, r AS (SELECT *, CASE WHEN block_type = 'table_row' THEN block_idx - row_number() OVER (PARTITION BY doc_id, block_type ORDER BY block_idx) END AS run FROM blocks),"
    " g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, min(block_idx) OVER (PARTITION BY doc_id, run) AS first, max(CASE WHEN run IS NOT NULL THEN block_idx END) OVER (PARTITION BY doc_id) AS last_row FROM r),"
    " c AS (SELECT *, run IS NOT NULL AND max(block_idx) OVER (PARTITION BY doc_id, run) < last_row AS closed FROM g)"
    " SELECT doc_id, block_idx, CASE WHEN closed AND n < 2 THEN 'para' ELSE block_type END AS block_type, CASE WHEN closed AND n >= 2 THEN (sum(CASE WHEN closed AND n >= 2 AND block_idx = first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) - 1)::INTEGER END AS table_idx FROM c"
)
def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_islands(_blocks(spark, sf_dir)).select("doc_id", "block_idx", "block_type", "table_idx")


@query(
    f"WITH {line_sql.lines()}, w AS (SELECT doc_id, n, list_transform(list_filter(string_split(replace(line, ' $ ', ' $'), ' '), lambda x: x <> ''), lambda x: {{'w': x, 'cells': []::VARCHAR[], 'buffer': '', 'before': ''}}) AS ws FROM lines),"
    " s AS (SELECT doc_id, n, list_reduce(ws, lambda s, x: (list_transform([{'s': s, 'x': x, 'back': x.w = 'of' AND len(s.cells) > 0 AND s.before <> 'str',"
    " 'kind': CASE WHEN regexp_matches(x.w, '^[-($%]*\\d[\\d.,]*[$%)]*$') THEN 'num' WHEN lower(x.w) IN ('yes', 'no') THEN 'yes_no' WHEN regexp_matches(x.w, '^-+\\$*$') THEN '-' WHEN x.w IN ('NA', 'N/A') THEN 'na' WHEN x.w LIKE '%:' THEN ':' ELSE 'str' END}], lambda v:"
    " (list_transform([{'v': v, 'cells': CASE WHEN v.back THEN v.s.cells[:-2] ELSE v.s.cells END, 'buffer': CASE WHEN v.back THEN v.s.buffer || v.s.cells[-1] ELSE v.s.buffer END, 'alone': v.kind IN ('num', 'yes_no', '-', 'na'), 'was': v.s.before = 'str'}], lambda y:"
    " {'w': y.v.x.w, 'cells': CASE WHEN y.alone THEN list_append(CASE WHEN y.was THEN list_append(y.cells, trim(y.buffer)) ELSE y.cells END, y.v.x.w) WHEN y.v.kind = ':' AND y.was THEN list_append(y.cells, trim(y.buffer) || ' ' || y.v.x.w) WHEN y.v.kind = ':' THEN list_append(y.cells, trim(y.buffer)) ELSE y.cells END,"
    " 'buffer': CASE WHEN y.alone AND NOT y.was THEN y.buffer WHEN y.alone OR y.v.kind = ':' THEN '' ELSE y.buffer || ' ' || y.v.x.w END, 'before': CASE WHEN y.v.kind = ':' THEN y.v.s.before ELSE y.v.kind END}))[1]))[1], {'w': '', 'cells': []::VARCHAR[], 'buffer': '', 'before': ''}) AS s FROM w)"
    " SELECT doc_id, n::INTEGER AS line_no, array_to_string(CASE WHEN s.buffer <> '' THEN list_append(s.cells, trim(s.buffer)) ELSE s.cells END, '|') AS cells FROM s"
)
def row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every line, as if it were a table row."""
    return lines.split_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.array_join(tables.row_cells(F.col("line")), "|").alias("cells"))


_ITEMS = "it AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)::INTEGER AS n FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with n, their place in the order; line numbers repeat."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(place))


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items as a table: a header row and a row an item."""
    items = _items(spark, sf_dir)
    body = items.select(F.col("l_orderkey").alias("table_id"), F.col("n").alias("row_idx"), F.lit(False).alias("is_header"), F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("long").cast("string"), F.col("l_shipdate").cast("string")).alias("cell_values"))
    head = items.select(F.col("l_orderkey").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_idx"), F.lit(True).alias("is_header"), F.array(F.lit(""), F.lit("Quantity"), F.lit("Shipped:")).alias("cell_values"))
    return head.unionByName(body).withColumn("is_row_group", F.lit(False)).withColumn("col_spans", F.lit(None).cast("array<int>"))


@query(
    f"WITH {_ITEMS}, i AS (SELECT l_orderkey AS t, n - 1 AS idx, 'part ' || l_partkey AS a, l_quantity::BIGINT::VARCHAR AS q, l_shipdate::VARCHAR AS d FROM it)"
    " SELECT t AS table_id, 'row' AS type, idx::BIGINT AS idx, a AS index_text, a || ' ' || q || ' ' || d AS text FROM i UNION ALL SELECT t, 'col', 0, 'Quantity', 'Quantity ' || string_agg(q, ' ' ORDER BY idx) FROM i GROUP BY t"
    " UNION ALL SELECT t, 'col', 1, 'Shipped', 'Shipped ' || string_agg(d, ' ' ORDER BY idx) FROM i GROUP BY t"
)
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_records(_order_tables(spark, sf_dir)).select("table_id", "type", F.col("idx").cast("long"), "index_text", "text")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = (F.col("l_partkey") * 7 % 500).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_idx"), left.alias("left"), (left + F.col("l_quantity").cast("double") * 3).alias("right"), F.col("l_linenumber").cast("string").alias("text"))


_BOXES = "b AS (SELECT l_orderkey AS table_id, l_linenumber AS row_idx, (l_partkey * 7 % 500)::DOUBLE AS l, (l_partkey * 7 % 500)::DOUBLE + l_quantity::DOUBLE * 3 AS r, l_linenumber::VARCHAR AS text FROM lineitem)"


@query(
    f"WITH {_BOXES}, m AS (SELECT *, max(r) OVER (PARTITION BY table_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),"
    " n AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY l, r ROWS UNBOUNDED PRECEDING) - 1 AS s FROM m)"
    " SELECT table_id, s::BIGINT AS span_idx, min(l) AS span_left, max(r) AS span_right FROM n GROUP BY table_id, s"
)
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_spans(_boxes(spark, sf_dir), ["table_id"])


@query("SELECT l_orderkey AS table_id, l_linenumber AS row_idx, round(o / (least(w1, w2) + 1e-5), 6) AS shorter, round(o / (greatest(w1, w2) + 1e-5), 6) AS longer FROM (SELECT *, greatest(0.0, least(a1, b1) - greatest(a0, b0)) AS o, a1 - a0 AS w1, b1 - b0 AS w2 FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 100)::DOUBLE AS a0, (l_partkey % 100)::DOUBLE + l_quantity::DOUBLE AS a1, (l_suppkey % 100)::DOUBLE AS b0, (l_suppkey % 100)::DOUBLE + l_linenumber * 10 AS b1 FROM lineitem))")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a0, b0 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    a1, b1 = a0 + F.col("l_quantity").cast("double"), b0 + F.col("l_linenumber") * 10
    both = [F.round(scalars.overlap(a0, a1, b0, b1, shorter), 6).alias(n) for n, shorter in (("shorter", True), ("longer", False))]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_idx"), *both)


# ---- matching -----------------------------------------------------------------------------------------------------------


@query(
    "WITH v AS (SELECT vec_id, label AS level, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id AS setting_id, level, e AS f FROM v WHERE vec_id % 50 = 0),"
    " p AS (SELECT v.vec_id, v.level, s.setting_id, list_inner_product(v.e, s.f) AS score FROM v LEFT JOIN s USING (level))"
    " SELECT vec_id, level, arg_max(setting_id, (score, -setting_id)) AS setting_id, round(max(score), 5) AS score, coalesce(max(score) > 0.9, false) AS is_duplicated, coalesce(max(score) > 0.9 AND arg_max(setting_id, (score, -setting_id)) % 100 = 0, false) AS ignore_all_after FROM p GROUP BY vec_id, level"
)
def similarity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against an ignore list for each label: those whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("level"), "embedding")
    settings = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("setting_id"), "level", "embedding", (F.col("vec_id") % 100 == 0).alias("ignore_all_after"))
    return matching.check_duplicates(vectors, settings).withColumn("score", F.round("score", 5))


_STOP = line_sql.listed(lexicon.STOP_WORDS)
_CONTENT = f"list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '' AND lower(x[1]) || x[2:] NOT IN {_STOP})"
_BARE = "replace(strip_accents(x), 'ß', 'ss')"
_TOKEN = f"lambda x: CASE WHEN regexp_matches({_BARE}, '[^0-9a-zA-Z]') OR (regexp_matches({_BARE}, '[0-9]') AND regexp_matches({_BARE}, '[a-zA-Z]')) THEN {_BARE} WHEN regexp_matches({_BARE}, '^[A-Z][a-z]*$') THEN lower({_BARE}) ELSE {_BARE} END"


@query(
    f"WITH RECURSIVE bt AS (SELECT item_id, {_CONTENT} AS t FROM benchmark), ev AS (SELECT DISTINCT item_id, unnest(list_concat([t], list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: t[i:i + 4]))) AS p FROM bt WHERE len(t) > 0),"
    f" pt AS (SELECT item_id, list_transform(p, {_TOKEN}) AS tokens FROM ev), di AS (SELECT tokens, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS meta FROM pt WHERE len(tokens) > 1 OR length(regexp_replace(tokens[1], '[^0-9a-zA-Z]', '', 'g')) > 1 GROUP BY tokens),"
    f" rw AS (SELECT doc_id, {_CONTENT} AS raw FROM documents), dt AS (SELECT doc_id, raw, list_transform(raw, {_TOKEN}) AS t FROM rw), po AS (SELECT doc_id, unnest(t) AS head, unnest(range(1, len(t) + 1)) AS i FROM dt), he AS (SELECT DISTINCT tokens[1] AS head FROM di), st AS (SELECT po.* FROM po SEMI JOIN he USING (head)),"
    " hi AS (SELECT st.doc_id, st.i, len(di.tokens) AS n, array_to_string(dt.raw[st.i:st.i + len(di.tokens) - 1], ' ') AS result, di.meta FROM st JOIN dt USING (doc_id) JOIN di ON di.tokens[1] = st.head AND dt.t[st.i:st.i + len(di.tokens) - 1] = di.tokens QUALIFY row_number() OVER (PARTITION BY st.doc_id, st.i ORDER BY len(di.tokens) DESC) = 1),"
    " nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hi), go AS (SELECT doc_id, k, i + n AS free, true AS taken FROM nu WHERE k = 1 UNION ALL SELECT nu.doc_id, nu.k, CASE WHEN nu.i >= go.free THEN nu.i + nu.n ELSE go.free END, nu.i >= go.free FROM go JOIN nu ON nu.doc_id = go.doc_id AND nu.k = go.k + 1)"
    ' SELECT nu.doc_id, (nu.i - 1)::INTEGER AS "start", nu.result, nu.meta FROM nu JOIN go ON go.doc_id = nu.doc_id AND go.k = nu.k WHERE taken'
)
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content words of each benchmark passage, whole and each five in a row, as phrases in all documents."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", matching.content_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    fives = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 4, F.lit(1))), lambda i: F.slice("t", i, F.lit(5)))
    every = passages.select("item_id", F.explode(F.array_distinct(F.concat(F.array("t"), fives))).alias("t"))
    phrases = every.select(F.col("item_id").alias("phrase_id"), F.array_join("t", " ").alias("phrase"))
    found = matching.dictionary_hits(table(spark, sf_dir, "documents"), phrases)
    return found.withColumn("meta", F.array_join(F.sort_array(F.transform("meta", lambda i: i.cast("string"))), ","))


@query(
    f"{_BLOCKS}, e AS (SELECT doc_id, (count(*) FILTER (block_type = 'table_row') = 0)::INTEGER AS flat FROM blocks GROUP BY doc_id)"
    " SELECT CASE WHEN l.doc_id IS NULL THEN 'missed' WHEN l.quality = e.flat THEN 'correct' ELSE 'incorrect' END AS verdict, count(*) AS n FROM e LEFT JOIN labels l USING (doc_id) GROUP BY 1"
)
def expected_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document has no table rows, as the expected table, against its quality label as the actual one; documents without a label are missed."""
    flat = (F.count_if(F.col("block_type") == "table_row") == 0).cast("int").alias("table")
    expected = _blocks(spark, sf_dir).groupBy(F.col("doc_id").alias("key")).agg(flat)
    actual = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("table"))
    return matching.compare_results(expected, actual).groupBy("verdict").agg(F.count("*").alias("n"))


# ---- layout -----------------------------------------------------------------------------------------------------------


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set on pages of 30 lines with a running head and a page number: positions and fonts follow from line numbers and lengths."""
    every = lines.split_lines(table(spark, sf_dir, "documents")).filter("line <> ''")
    n, page = F.col("line_no"), F.floor(F.col("line_no") / 30).cast("int")
    on_page = n % 30
    big = F.length("line") < 40
    body = every.select("doc_id", page.alias("page_idx"), (on_page + 1).alias("line_no"), F.col("line").alias("text"), (F.lit(120.0) + on_page * 18 + F.floor(on_page / 5) * 7).alias("top"), F.when(n % 7 == 0, 90.0).otherwise(72.0).alias("left"), F.least(F.length("line") * 5.0, F.lit(450.0)).alias("width"), F.when(big, 14.0).otherwise(10.0).alias("height"), F.when(big, 14.0).otherwise(10.0).alias("font_size"), F.when(big, 600).otherwise(400).alias("font_weight"))
    pages = body.select("doc_id", "page_idx").distinct()
    extra = F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("text"), F.lit(30.0).alias("top")), F.struct(F.lit(99).alias("line_no"), (F.col("page_idx") + 1).cast("string").alias("text"), F.lit(770.0).alias("top"))))
    margins = pages.select("doc_id", "page_idx", extra.alias("e")).select("doc_id", "page_idx", "e.line_no", "e.text", "e.top", F.lit(280.0).alias("left"), F.lit(60.0).alias("width"), F.lit(8.0).alias("height"), F.lit(8.0).alias("font_size"), F.lit(400).alias("font_weight"))
    return body.unionByName(margins).withColumns({"font_family": F.lit("Times"), "font_style": F.lit("normal"), "page_width": F.lit(600.0), "page_height": F.lit(800.0)})


_LAYOUT = (
    f"WITH {line_sql.lines()}, body AS (SELECT doc_id, (n // 30)::INTEGER AS page_idx, (n % 30 + 1)::INTEGER AS line_no, line AS text, 120.0::DOUBLE + (n % 30) * 18 + (n % 30) // 5 * 7 AS top, CASE WHEN n % 7 = 0 THEN 90.0 ELSE 72.0 END::DOUBLE AS l,"
    " least(length(line) * 5.0, 450.0)::DOUBLE AS width, CASE WHEN length(line) < 40 THEN 14.0 ELSE 10.0 END::DOUBLE AS height, CASE WHEN length(line) < 40 THEN 600 ELSE 400 END AS weight FROM lines WHERE line <> ''),"
    " pg AS (SELECT DISTINCT doc_id, page_idx FROM body), layout AS (SELECT * FROM body UNION ALL SELECT doc_id, page_idx, 0, 'Document ' || doc_id, 30.0, 280.0, 60.0, 8.0, 400 FROM pg UNION ALL SELECT doc_id, page_idx, 99, (page_idx + 1)::VARCHAR, 770.0, 280.0, 60.0, 8.0, 400 FROM pg)"
)


@query(
    f"{_LAYOUT}, p AS (SELECT *, lag(top) OVER w AS pt, lag(height) OVER w AS ph, lag(weight) OVER w AS pw FROM layout WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_no)),"
    " sp AS (SELECT doc_id, height, weight, round(top - pt - ph, 2) AS space, count(*) AS n FROM p WHERE pt IS NOT NULL AND ph = height AND pw = weight AND NOT abs(top - pt) < ph / 4 AND top - pt - ph > 0 GROUP BY ALL),"
    " md AS (SELECT doc_id, height, weight, arg_max(space, (n, -space)) AS modal_space FROM sp GROUP BY ALL)"
    " SELECT doc_id, height AS font_size, weight AS font_weight, count(*) AS n_lines, round(avg(height), 6) AS mean_height, round(median(height), 6) AS median_height, round(stddev_pop(height), 6) AS sd_height, any_value(modal_space) AS modal_space FROM layout LEFT JOIN md USING (doc_id, height, weight) GROUP BY doc_id, height, weight"
)
def style_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = layout.style_stats(_layout(spark, sf_dir))
    return got.select("doc_id", "font_size", "font_weight", "n_lines", *(F.round(c, 6).alias(c) for c in ("mean_height", "median_height", "sd_height")), "modal_space")


@query(
    f"{_LAYOUT}, z AS (SELECT doc_id, page_idx, CASE WHEN top < 144 THEN 'header' WHEN top > 720 THEN 'footer' END AS zone, trim(regexp_replace(CASE WHEN regexp_matches(text, '^\\s*([ivxlcIVXLC]+|\\d+)\\s*$') THEN '' ELSE text END, '(?i)\\b(page)\\s+\\d+(\\s+of\\s+\\d+)?', '\\1', 'g')) AS key_text, top::INTEGER AS top, l::INTEGER AS l FROM layout),"
    " k AS (SELECT * FROM z WHERE zone IS NOT NULL), q AS (SELECT DISTINCT doc_id, zone, key_text, top, l FROM k),"
    " g AS (SELECT q.doc_id, q.zone, q.key_text, q.top, q.l, count(DISTINCT k.page_idx) AS n_pages, min(k.page_idx) AS first_page, max(k.page_idx) AS last_page FROM q JOIN k ON k.doc_id = q.doc_id AND k.zone = q.zone AND k.key_text = q.key_text AND abs(k.top - q.top) < 20 AND abs(k.l - q.l) < 20 GROUP BY ALL),"
    " t AS (SELECT doc_id, count(DISTINCT page_idx) AS pages FROM layout GROUP BY doc_id)"
    " SELECT doc_id, zone, key_text, top, l AS left, n_pages, first_page, last_page FROM g JOIN t USING (doc_id) WHERE n_pages > 1 AND (last_page - first_page) / (n_pages - 1) <= 2 AND (n_pages > pages * 0.5 OR n_pages > 5 OR (key_text = '' AND n_pages > pages * 0.2))"
)
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.headers_and_footers(_layout(spark, sf_dir))


_LAYOUT_ROWS = (
    _LAYOUT + ", z AS (SELECT doc_id, page_idx, line_no, CASE WHEN top < 144 THEN 'header' WHEN top > 720 THEN 'footer' END AS zone, trim(regexp_replace(CASE WHEN regexp_matches(text, '^\\s*([ivxlcIVXLC]+|\\d+)\\s*$') THEN '' ELSE text END, '(?i)\\b(page)\\s+\\d+(\\s+of\\s+\\d+)?', '\\1', 'g')) AS key_text, top::INTEGER AS top, l::INTEGER AS l FROM layout),"
    " k AS (SELECT * FROM z WHERE zone IS NOT NULL), q AS (SELECT DISTINCT doc_id, zone, key_text, top, l FROM k),"
    " g AS (SELECT q.doc_id, q.zone, q.key_text, q.top, q.l, count(DISTINCT k.page_idx) AS n_pages, min(k.page_idx) AS first_page, max(k.page_idx) AS last_page FROM q JOIN k ON k.doc_id = q.doc_id AND k.zone = q.zone AND k.key_text = q.key_text AND abs(k.top - q.top) < 20 AND abs(k.l - q.l) < 20 GROUP BY ALL),"
    " t AS (SELECT doc_id, count(DISTINCT page_idx) AS pages FROM layout GROUP BY doc_id), hf AS (SELECT g.* FROM g JOIN t USING (doc_id) WHERE n_pages > 1 AND (last_page - first_page) / (n_pages - 1) <= 2 AND (n_pages > pages * 0.5 OR n_pages > 5 OR (key_text = '' AND n_pages > pages * 0.2))),"
    " gone AS (SELECT doc_id, page_idx, line_no FROM k WHERE key_text = '' OR EXISTS (SELECT 1 FROM hf WHERE hf.doc_id = k.doc_id AND hf.zone = k.zone AND hf.key_text = k.key_text AND hf.top = k.top AND hf.l = k.l)),"
    " body2 AS (SELECT layout.* FROM layout ANTI JOIN gone USING (doc_id, page_idx, line_no)), seen AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) - 1 AS n FROM body2), kept_rows AS (SELECT doc_id, page_idx, n, text AS line FROM seen),"
    " ss AS (SELECT *, lag(top) OVER w AS pt, lag(height) OVER w AS ph, lag(weight) OVER w AS pw FROM layout WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_no)),"
    " sp AS (SELECT doc_id, height, weight, round(top - pt - ph, 2) AS space, count(*) AS c FROM ss WHERE pt IS NOT NULL AND ph = height AND pw = weight AND NOT abs(top - pt) < ph / 4 AND top - pt - ph > 0 GROUP BY ALL), md AS (SELECT doc_id, height, weight, arg_max(space, (c, -space)) AS modal FROM sp GROUP BY ALL), "
)
_LAYOUT_BLOCKS = (
    _LAYOUT_ROWS + line_sql.features("doc_id, page_idx", "kept_rows")
    + ", j AS (SELECT typed.doc_id, typed.page_idx, typed.n, typed.line, typed.line_type, ends_with_period, incomplete_line, numbered_line, top, l, width, height, weight, modal FROM typed JOIN seen USING (doc_id, page_idx, n) LEFT JOIN md USING (doc_id, height, weight)),"
    " e AS (SELECT *, lag(page_idx) OVER w AS ppage, lag(top + height) OVER w AS pbottom, lag(line_type) OVER w AS ptype, lag(ends_with_period) OVER w AS pend, lag(incomplete_line) OVER w AS pinc, lag(height) OVER w AS ph, lag(weight) OVER w AS pw FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, n)),"
    " nb AS (SELECT *, ppage IS NULL OR ph <> height OR pw <> weight OR (ppage = page_idx AND top - pbottom > coalesce(modal, 0) * 1.2 + 0.5) OR line_type = 'list_item' OR numbered_line OR (ptype = 'header' AND NOT pinc) OR (ppage <> page_idx AND pend) AS new FROM e),"
    " ib AS (SELECT *, (sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_idx, n ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS block_idx FROM nb),"
    " lb AS (SELECT doc_id, block_idx, arg_min(page_idx, (page_idx, n)) AS page_idx, arg_min(line_type, (page_idx, n)) AS t, count(*) AS c, replace(string_agg(line, ' ' ORDER BY page_idx, n), '- ', '-') AS block_text, min(top) AS top, min(l) AS begins, max(l + width) - min(l) AS width, max(top + height) - min(top) AS height, arg_min(height, (page_idx, n)) AS font_size, arg_min(weight, (page_idx, n)) AS font_weight FROM ib GROUP BY doc_id, block_idx),"
    " laid AS (SELECT doc_id, page_idx, block_idx, CASE WHEN t = 'table_row' THEN 'para' WHEN c > 1 AND t <> 'list_item' THEN 'para' ELSE t END AS block_type, block_text, top, begins, width, height, font_size, font_weight FROM lb)"
)


@query(f"{_LAYOUT_BLOCKS} SELECT * FROM laid")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = layout.layout_blocks(_layout(spark, sf_dir))
    return made.select("doc_id", "page_idx", "block_idx", "block_type", "block_text", "box.top", F.col("box.left").alias("begins"), "box.width", "box.height", "font_size", "font_weight")


def _scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("n").alias("block_idx"), (F.col("l_partkey") % 700).cast("double").alias("top"), (F.col("l_suppkey") % 300).cast("double").alias("left"), F.lit(200.0).alias("width"))


@query(
    f"WITH {_ITEMS}, b AS (SELECT l_orderkey AS doc_id, n AS block_idx, (l_partkey % 700)::DOUBLE AS top, (l_suppkey % 300)::DOUBLE AS l FROM it), m AS (SELECT *, lag(top) OVER (PARTITION BY doc_id ORDER BY block_idx) AS p FROM b),"
    " r AS (SELECT *, sum(CASE WHEN top < p - 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS run FROM m), g AS (SELECT doc_id, run, min(block_idx) AS first_block, max(block_idx) AS last_block, count(*) AS n, min(l) AS l, max(l + 200) AS r FROM r GROUP BY doc_id, run)"
    " SELECT doc_id, 0 AS page_idx, run::BIGINT AS run_idx, first_block, last_block, n, l AS left, r AS right, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS ratio FROM g"
)
def reading_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_runs(_scattered(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(
    f"WITH {_ITEMS}, b AS (SELECT l_orderkey AS doc_id, n AS block_idx, (l_partkey % 700)::DOUBLE AS top, (l_suppkey % 300)::DOUBLE AS l, (l_suppkey % 300)::DOUBLE + 200 AS r FROM it), m AS (SELECT *, lag(top) OVER (PARTITION BY doc_id ORDER BY block_idx) AS p FROM b),"
    " x AS (SELECT *, sum(CASE WHEN top < p - 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS run FROM m), g AS (SELECT doc_id, run, count(*) AS n, min(l) AS l, max(r) AS r FROM x GROUP BY doc_id, run), h AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS ratio FROM g),"
    " k AS (SELECT *, max(r) OVER (PARTITION BY doc_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h WHERE ratio >= 0.2), c AS (SELECT *, sum(CASE WHEN reach IS NULL OR l >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS col FROM k),"
    " cs AS (SELECT doc_id, col, min(l) AS f, max(r) AS t FROM c GROUP BY doc_id, col), pg AS (SELECT doc_id, count(*) AS runs, max(l) AS pl, min(r) AS pr FROM g GROUP BY doc_id), nc AS (SELECT doc_id, count(*) AS cols FROM cs GROUP BY doc_id),"
    " o AS (SELECT x.*, runs, pl, pr, coalesce(cols, 0) AS cols, (SELECT arg_max(col, (least(x.r, cs.t) - greatest(x.l, cs.f), -col)) FROM cs WHERE cs.doc_id = x.doc_id) AS best FROM x JOIN pg USING (doc_id) LEFT JOIN nc USING (doc_id)),"
    " z AS (SELECT *, cols > 1 AND runs > 1 AS side, NOT (cols > 1 AND runs > 1) AND runs = 2 AND pl < pr AS merges FROM o)"
    " SELECT doc_id, 0 AS page_idx, block_idx, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN side THEN best ELSE 0 END, CASE WHEN side OR merges THEN floor(top / 15) ELSE 0 END, CASE WHEN side OR merges THEN l ELSE 0 END, block_idx) - 1 AS order FROM z".replace(" AS order FROM", ' AS "order" FROM')
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_scattered(spark, sf_dir)).select("doc_id", "page_idx", "block_idx", "order")


@query(
    "SELECT l_orderkey AS doc_id, l_linenumber AS block_idx, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY (c AND k AND p <> '') DESC, size DESC, weight DESC, CASE style WHEN 'bold' THEN 3 WHEN 'italic' THEN 1 ELSE 2 END DESC, p <> '' DESC, regexp_matches(p, '^\\p{Lu}') DESC, k DESC, c, l) - 1 AS level"
    " FROM (SELECT l_orderkey, l_linenumber, l_partkey % 2 = 0 AS c, l_suppkey % 2 = 0 AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'A.' WHEN l_linenumber % 3 = 1 THEN '1.' ELSE '' END AS p, (10 + l_quantity::BIGINT % 3)::DOUBLE AS size, 400 + 200 * (l_partkey % 2) AS weight, ['bold', 'normal', 'italic'][(l_suppkey % 3 + 1)::INTEGER] AS style, (l_partkey % 5 * 10)::DOUBLE AS l FROM lineitem)"
)
def header_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    prefix = F.when(n % 3 == 0, "A.").when(n % 3 == 1, "1.").otherwise("")
    style = F.element_at(F.array(F.lit("bold"), F.lit("normal"), F.lit("italic")), (supp % 3 + 1).cast("int"))
    heads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("block_idx"), (part % 2 == 0).alias("is_centered"), (supp % 2 == 0).alias("is_caps"), prefix.alias("prefix"), (F.col("l_quantity").cast("long") % 3 + 10).cast("double").alias("font_size"), (part % 2 * 200 + 400).alias("font_weight"), style.alias("font_style"), (part % 5 * 10).cast("double").alias("left"))
    return layout.header_rank(heads).select("doc_id", "block_idx", F.col("level").cast("long"))


@query()
def organised_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = _layout(spark, sf_dir)
    made = layout.layout_blocks(lines_).withColumn("page_width", F.lit(600.0))
    return merging.organise(layout.font_headers(made, layout.style_stats(lines_)))


_NUMBERED = line_sql.quoted(merging.NUMBERED)


@query(
    f"{_LAYOUT_BLOCKS}, h AS (SELECT doc_id, block_idx, block_text, font_size, font_weight, begins, width, regexp_matches(block_text, {_NUMBERED}) AS m, trim(regexp_extract(block_text, {_NUMBERED}, 1)) AS p1, trim(regexp_extract(block_text, {_NUMBERED}, 2)) AS p2, trim(regexp_extract(block_text, {_NUMBERED}, 3)) AS p3 FROM laid WHERE block_type = 'header'),"
    f" hc AS (SELECT *, CASE WHEN m THEN p1 ELSE 'no_prefix' END AS prefix, CASE WHEN m THEN p2 END AS number_part, CASE WHEN NOT m THEN regexp_matches(block_text, {line_sql.UPPER}) WHEN p3 <> '' THEN regexp_matches(p3, {line_sql.UPPER}) ELSE regexp_matches(p1, {line_sql.UPPER}) END AS caps, abs(begins + width / 2 - 300) < 6 AND width * 2 < 600 AS mid FROM h),"
    " hl AS (SELECT *, CASE WHEN mid THEN 0.0 ELSE begins END AS l0 FROM hc WHERE prefix <> ''), ct AS (SELECT doc_id, prefix, mid, caps, font_size, font_weight, l0, count(*) AS n FROM hl GROUP BY ALL),"
    " cm AS (SELECT doc_id, prefix, arg_max({'mid': mid, 'caps': caps, 's': font_size, 'w': font_weight, 'l': l0}, (n, font_size, font_weight, -l0, mid, caps)) AS x FROM ct WHERE prefix <> 'no_prefix' GROUP BY doc_id, prefix),"
    " sy AS (SELECT doc_id, prefix, x.mid AS mid, x.caps AS caps, x.s AS font_size, x.w AS font_weight, x.l AS l0 FROM cm UNION ALL SELECT doc_id, prefix, mid, caps, font_size, font_weight, l0 FROM ct WHERE prefix = 'no_prefix'), pf AS (SELECT *, CASE WHEN prefix = 'no_prefix' THEN '' ELSE prefix END AS p FROM sy),"
    " rk AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY (mid AND caps AND p <> '') DESC, font_size DESC, font_weight DESC, p <> '' DESC, regexp_matches(p, '^\\p{Lu}') DESC, caps DESC, mid, l0) - 1 AS level FROM pf)"
    " SELECT hl.doc_id, hl.block_idx, hl.prefix, hl.number_part, rk.level::INTEGER AS level FROM hl JOIN rk ON rk.doc_id = hl.doc_id AND rk.prefix = hl.prefix AND (hl.prefix <> 'no_prefix' OR (rk.mid = hl.mid AND rk.caps = hl.caps AND rk.font_size = hl.font_size AND rk.font_weight = hl.font_weight AND rk.l0 = hl.l0))"
)
def header_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = layout.layout_blocks(_layout(spark, sf_dir)).withColumn("page_width", F.lit(600.0))
    return merging.numbered_levels(made).select("doc_id", "block_idx", "prefix", "number_part", "level")


@query(
    f"{_LAYOUT}, r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY height DESC) AS rank FROM layout WHERE page_idx < 2 AND top < 400 AND length(trim(text)) > 2), k AS (SELECT * FROM r WHERE rank <= 2),"
    " n AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER w > 1 OR page_idx <> lag(page_idx) OVER w THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY doc_id, rank ORDER BY page_idx, line_no)), u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, rank ORDER BY page_idx, line_no ROWS UNBOUNDED PRECEDING) AS run FROM n),"
    " t AS (SELECT doc_id, rank, string_agg(text, ' ' ORDER BY page_idx, line_no) AS t FROM u WHERE run = 0 GROUP BY doc_id, rank) SELECT doc_id, max(t) FILTER (rank = 1) AS title, max(t) FILTER (rank = 2) AS subtitle FROM t GROUP BY doc_id"
)
def layout_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.titles(_layout(spark, sf_dir))


_RULES = "s AS (SELECT l_orderkey % 500 AS doc_id, (l_partkey % 300)::DOUBLE AS b, (l_partkey % 300)::DOUBLE + l_quantity::DOUBLE AS e, (l_suppkey % 40)::DOUBLE AS y FROM lineitem)"


@query(
    f"WITH {_RULES}, m AS (SELECT *, max(e) OVER (PARTITION BY doc_id, y ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),"
    " r AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, y ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run FROM m)"
    " SELECT doc_id, y, min(b) AS x_begin, max(e) AS x_end FROM r GROUP BY doc_id, y, run"
)
def ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_partkey") % 300).cast("double")
    y = (F.col("l_suppkey") % 40).cast("double")
    shapes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.lit(0).alias("page_idx"), F.lit("line").alias("kind"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity").cast("double")).alias("x2"), y.alias("y2"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return merging.ruled_lines(shapes).select("doc_id", F.col("at").alias("y"), F.col("begin").alias("x_begin"), F.col("end").alias("x_end"))


@query()
def indent_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = layout.layout_blocks(_layout(spark, sf_dir)).withColumn("page_width", F.lit(600.0))
    return indent.indent_levels(made).select("doc_id", "block_idx", "block_type", "level")


@query(
    f"WITH {_ITEMS}, i AS (SELECT l_orderkey AS doc_id, n AS row_idx, unnest(['part ' || l_partkey, l_quantity::BIGINT::VARCHAR, l_shipdate::VARCHAR]) AS text, unnest([0, 1, 2]) AS c FROM it UNION ALL SELECT DISTINCT l_orderkey, 0, unnest(['Quantity', 'Shipped:']), unnest([1, 2]) FROM it),"
    " b AS (SELECT doc_id, row_idx, text, c * 150.0 + length(text) % 3 AS l, c * 150.0 + 60 + length(text) * 2 AS r FROM i), pr AS (SELECT doc_id, row_idx, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS k FROM b GROUP BY doc_id, row_idx), mo AS (SELECT doc_id, max(n) FILTER (k <= 5) AS most FROM pr GROUP BY doc_id),"
    " hd AS (SELECT doc_id, min(row_idx) AS head, arg_min(n, row_idx) AS n_head FROM pr JOIN mo USING (doc_id) WHERE n >= most - 1 GROUP BY doc_id), sp AS (SELECT b.doc_id, row_number() OVER w - 1 AS s, coalesce((lag(r) OVER w + l) / 2, '-inf'::DOUBLE) AS f, coalesce((lead(l) OVER w + r) / 2, 'inf'::DOUBLE) AS t FROM b JOIN hd ON hd.doc_id = b.doc_id AND row_idx = head WINDOW w AS (PARTITION BY b.doc_id ORDER BY l)),"
    " pl AS (SELECT b.doc_id, row_idx, text, l, arg_max(s, (least(r, t) - greatest(l, f), -s)) AS s, count(*) FILTER (f >= l AND t <= r) AS below FROM b JOIN sp USING (doc_id) GROUP BY ALL), gr AS (SELECT doc_id, row_idx, s, string_agg(text, ' ' ORDER BY l) AS cell, max(greatest(below, 1)) AS span FROM pl GROUP BY ALL),"
    " al AS (SELECT r.doc_id, r.row_idx, sp.s, coalesce(cell, '') AS cell, coalesce(span, 1) AS span FROM pr r JOIN sp USING (doc_id) LEFT JOIN gr ON gr.doc_id = r.doc_id AND gr.row_idx = r.row_idx AND gr.s = sp.s), ou AS (SELECT doc_id, row_idx, string_agg(cell, '|' ORDER BY s) AS cells, string_agg(span::VARCHAR, '|' ORDER BY s) AS spans, count(*) AS columns FROM al GROUP BY ALL),"
    " nn AS (SELECT doc_id, row_idx, count(*) AS n FROM gr GROUP BY ALL) SELECT ou.doc_id, ou.row_idx, cells, spans, ou.row_idx <= head AND n_head > 1 AS is_header, NOT (ou.row_idx <= head AND n_head > 1) AND nn.n = 1 AND columns > 1 AS is_row_group FROM ou JOIN hd USING (doc_id) JOIN nn ON nn.doc_id = ou.doc_id AND nn.row_idx = ou.row_idx"
)
def positioned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items as positioned cells: three columns of texts under a header row."""
    rows_ = _order_tables(spark, sf_dir).select(F.col("table_id").alias("doc_id"), F.lit(0).alias("table_idx"), "row_idx", F.posexplode("cell_values").alias("c", "text"))
    cells = rows_.filter("text <> ''").select("doc_id", "table_idx", "row_idx", "text", (F.col("c") * 150.0 + F.length("text") % 3).alias("left"), (F.col("c") * 150.0 + 60 + F.length("text") * 2).alias("right"))
    made = tables.positioned_table(cells)
    return made.select("doc_id", "row_idx", F.array_join("cell_values", "|").alias("cells"), F.array_join(F.transform("col_spans", lambda n: n.cast("string")), "|").alias("spans"), "is_header", "is_row_group")


# ---- scalars -------------------------------------------------------------------------------------------------------------


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).filter("length(word) > 1").distinct()


_UP, _LOW = line_sql.UPPER, line_sql.quoted(r"^[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*$")


@query(
    f"SELECT word, CASE WHEN regexp_matches(word, {_UP}) OR regexp_matches(word, {_LOW}) THEN word WHEN regexp_matches(word, '^\\p{{Lu}}\\p{{Ll}}') THEN upper(word[1]) || lower(word[2:]) WHEN regexp_matches(word, '^\\p{{Lu}}') THEN upper(replace(word, 'ß', 'SS')) ELSE lower(word) END AS fixed"
    " FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE length(word) > 1"
)
def mixed_case_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_words(spark, sf_dir).select("word", strings.fix_mixed_case(F.col("word")).alias("fixed"))


def _token_text(c: Column) -> Column:
    return F.array_join(scalars.tokens(c), " ")


@query(
    "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(translate(translate(lower(coalesce(text, '')), '-/', '  '), '�\\(*,.?•➢ƒ–)''\"—', ''), '[0-9]+[a-zA-Z’]+', '', 'g'), '[''’]s', '', 'g'), '\\s+'),"
    " lambda w: w <> '' AND NOT regexp_matches(w, '^\\p{Nd}+$') AND NOT regexp_matches(w, '[%$]$') AND NOT regexp_matches(w, '^\\$')) AS ws FROM documents)"
    " SELECT doc_id, CASE WHEN len(ws) > 0 THEN array_to_string(ws, ' ') ELSE 'unknown' END AS tokens FROM t"
)
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _token_text(F.col("text")).alias("tokens"))
