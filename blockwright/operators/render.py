"""Blocks to JSON and HTML, a document at a time: pieces are made row by row and joined once by document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sentences import sentences

SCALE = 1.2
# Class names in rendered blocks.
TITLE_CLASS, HEADER_CLASS, BODY_CLASS, LIST_CLASS, ROW_CLASS = "nlm-text-title", "nlm-text-header", "nlm-text-body", "nlm-list-item", "nlm-table-row"
SENTENCE_MARK, BLOCK_MARK, FULL_ROW = "nlm_sent_", "nlm_block_", "nlm_full_row"
# The styles of formats without styles of their own, by class; their levels are their places.
STYLES = {
    TITLE_CLASS: ("Roboto, Georgia, serif", "bold", 14.0, "500", "left", "left"),
    HEADER_CLASS: ("Roboto, Georgia, serif", "normal", 12.0, "600", "left", "left"),
    BODY_CLASS: ("Roboto, Georgia, serif", "normal", 10.0, "400", "left", "left"),
}
TABLE_COLUMNS = {
    "page_idx": "int",
    "level": "int",
    "header_text": "string",
    "block_class": "string",
    "cell_values": "array<string>",
    "col_spans": "array<int>",
    "col_span": "int",
    "is_header_group": "boolean",
    "is_header": "boolean",
    "is_row_group": "boolean",
    "is_table_start": "boolean",
    "is_table_end": "boolean",
    "box": "struct<top:double,left:double,width:double,height:double>",
}


def complete(blocks: DataFrame) -> DataFrame:
    """Blocks with all columns of the renderers (page 0 and level 0, no table, no box where they are missing) and with sentences."""
    out = blocks
    for name, kind in TABLE_COLUMNS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit({"page_idx": 0, "level": 0, "header_text": ""}.get(name)).cast(kind) if name in ("page_idx", "level", "header_text") else F.lit(None).cast(kind))
    for name in ("is_header_group", "is_header", "is_row_group", "is_table_start", "is_table_end"):
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    default = F.when(F.col("block_type") == "header", HEADER_CLASS).when(F.col("block_type") == "list_item", LIST_CLASS).when(F.col("block_type") == "table_row", ROW_CLASS).otherwise(BODY_CLASS)
    out = out.withColumn("block_class", F.coalesce("block_class", default))
    return out if "block_sents" in out.columns else out.withColumn("block_sents", sentences(F.col("block_text")))


def with_tables(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks with in_table and table_idx, from a row that starts a table to the one that ends it."""
    w = Window.partitionBy(*keys).orderBy("block_idx")
    started = F.sum(F.col("is_table_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = F.coalesce(F.sum(F.col("is_table_end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("in_table", started > ended).withColumn("table_idx", F.when(started > ended, ended.cast("int")))


def _bbox() -> Column:
    b = F.col("box")
    return F.when(b.isNotNull(), F.array(b["left"], b["top"], b["left"] + b["width"], b["top"] + b["height"])).otherwise(F.array().cast("array<double>"))


def json_blocks(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each JSON block: tag, page_idx, block_class, sentences, bbox, block_idx, level, and of a table its place, name and rows.

    A table row that stands alone is a paragraph; paragraphs and list items without sentences are left out.
    """
    rows = with_tables(complete(blocks), keys)
    tag = F.when(F.col("block_type").isin("header", "list_item"), F.col("block_type")).when(F.col("block_type").isin("para", "numbered_list_item", "table_row"), "para")
    said = F.when(F.col("block_type").isin("header", "table_row"), F.array("block_text")).otherwise(F.col("block_sents"))
    plain = rows.filter(~F.col("in_table")).select(*keys, tag.alias("tag"), "page_idx", "block_class", said.alias("sentences"), _bbox().alias("bbox"), "block_idx", "level").filter(F.col("tag").isNotNull() & (F.size("sentences") > 0))
    cells = F.coalesce("cell_values", F.array("block_text"))
    span = lambda i: F.coalesce(F.get("col_spans", i), F.lit(1))
    kind = F.when(F.col("is_row_group"), "full_row").when(F.col("is_header_group") | F.col("is_header"), "table_header").otherwise("table_data_row")
    made = F.when(F.col("is_row_group"), F.array(F.struct(F.get(cells, F.lit(0)).alias("cell_value"), F.col("col_span").alias("col_span")))).otherwise(
        F.transform(cells, lambda v, i: F.struct(v.alias("cell_value"), F.when(F.col("is_header_group"), span(i)).alias("col_span")))
    )
    inside = rows.filter("in_table").withColumn("r", F.struct(F.col("block_idx"), kind.alias("type"), made.alias("cells")))
    first = F.min_by(F.struct("page_idx", "block_class", "block_idx", "level", F.col("header_text").alias("name"), F.coalesce("box.top", F.lit(0.0)).alias("top"), F.coalesce("box.left", F.lit(0.0)).alias("left")), "block_idx").alias("f")
    tables = inside.groupBy(*keys, "table_idx").agg(first, F.sort_array(F.collect_list("r")).alias("table_rows"), F.max_by("box", "block_idx").alias("end"))
    bbox = F.when(F.col("end").isNotNull(), F.array("f.left", "f.top", F.col("f.left") + F.col("end.width"), F.col("f.top") + F.col("end.height"))).otherwise(F.array().cast("array<double>"))
    table = tables.select(*keys, F.lit("table").alias("tag"), "f.page_idx", "f.block_class", bbox.alias("bbox"), "f.block_idx", "f.level", "f.name", "f.top", "f.left", "table_rows")
    return plain.unionByName(table, allowMissingColumns=True)


def render_json(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), envelope: bool = False) -> DataFrame:
    """keys and json: {"styles", "blocks"} of each document, or the service's reply around it."""
    made = json_blocks(blocks, keys)
    fields = [c for c in made.columns if c not in keys]
    listed = made.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block_idx", F.struct(*fields).alias("b")))).alias("x"))
    styles = F.array(
        *(
            F.struct(F.lit(name).alias("class_name"), F.struct(*(F.lit(v).alias(k) for k, v in zip(("font-family", "font-style", "font-size", "font-weight", "text-transform", "text-align"), (s[0], s[1], s[2] * SCALE, *s[3:]), strict=True))).alias("style"))
            for name, s in STYLES.items()
        )
    )
    document = F.struct(styles.alias("styles"), F.transform("x", lambda e: e["b"]).alias("blocks"))
    if envelope:
        pages = F.array_max(F.transform("x", lambda e: e["b"]["page_idx"]))
        result = F.struct(F.array(F.lit(1), F.lit(1)).alias("page_dim"), pages.alias("num_pages"), F.struct(document.alias("document")).alias("result"))
        document = F.struct(F.lit(200).alias("status"), result.alias("return_dict"))
    return listed.select(*keys, F.to_json(document).alias("json"))


def _css() -> str:
    rules = "".join(
        f".{name} {{\nfont-family: {s[0]};font-style: {s[1]};font-size: {s[2] * SCALE}px;font-weight: {s[3]};margin-left: {level * 20}px;text-transform: {s[4]};text-align: {s[5]}\n}}\n" for level, (name, s) in enumerate(STYLES.items())
    )
    # Fixed value: the style sheet's rules for tables, lists and headers.
    return f"<style>\n{rules}table {{border-collapse: collapse; margin-top: 10px}}table, th, td {{border: 1px solid lightgray;padding: 5px;}}th {{background: #337ab773}}li {{padding-left: 30px; list-style: none; margin-top: 10px}}li::first-letter {{color: #5656a3}}h4 {{color: #337ab7}}.{FULL_ROW} {{background: #dfe5e7; font-weight: 600; color: #5656a3}}</style>"


def render_html(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys and html: h4, p, li and table elements in order; sentences are numbered through a document, a table row counts as one."""
    rows = with_tables(complete(blocks), keys)
    w = Window.partitionBy(*keys).orderBy("block_idx")
    nested = ~F.col("in_table") & F.col("block_type").isin("para", "list_item", "numbered_list_item")
    number = F.when(nested, F.size("block_sents")).otherwise(1)
    rows = rows.withColumn("sent", F.coalesce(F.sum(number).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opens = nested | F.col("is_table_start")
    rows = rows.withColumn("nest", F.coalesce(F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    margin = F.format_string("style='margin-left: %dpx;' page_idx=%d", F.col("level") * 20, F.col("page_idx"))
    attributes = F.concat(margin, F.lit(' class="'), F.col("block_class"), F.lit(f" {SENTENCE_MARK}"), F.col("sent").cast("string"), F.lit('"'))
    tag = F.when(F.col("block_type") == "list_item", "li").otherwise("p")
    one = F.concat(F.lit("<"), tag, F.lit(" "), margin, F.lit(' class="'), F.col("block_class"), F.lit(f" {SENTENCE_MARK}"), F.col("sent").cast("string"), F.lit('">'), F.get("block_sents", F.lit(0)), F.lit("</"), tag, F.lit(">"))
    spans = F.array_join(F.transform("block_sents", lambda s, i: F.concat(F.lit(f'<span class="{SENTENCE_MARK}'), (F.col("sent") + i).cast("string"), F.lit('">'), s, F.lit(" </span>"))), "")
    many = F.concat(F.lit(" <"), tag, F.lit(" "), margin, F.lit(' class="'), F.col("block_class"), F.lit(f" {BLOCK_MARK}"), F.col("nest").cast("string"), F.lit('">'), spans, F.lit("</"), tag, F.lit(">"))
    cells = F.coalesce("cell_values", F.array("block_text"))
    cell = F.transform(
        cells,
        lambda v, i: F.when(F.col("is_header_group"), F.concat(F.lit("<th "), margin, F.lit(" colspan="), F.coalesce(F.get("col_spans", i), F.lit(1)).cast("string"), F.lit(">"), v, F.lit("</th>")))
        .when(F.col("is_header"), F.concat(F.lit("<th "), margin, F.lit(">"), v, F.lit("</th>")))
        .otherwise(F.concat(F.lit("<td "), margin, F.lit(">"), v, F.lit("</td>"))),
    )
    full = F.concat(F.lit("<td "), margin, F.lit(f" class='{FULL_ROW}' colspan="), F.coalesce(F.col("col_span"), F.lit(1)).cast("string"), F.lit(">"), F.get(cells, F.lit(0)), F.lit("</td>"))
    head = F.concat(F.lit("<table "), attributes, F.format_string(' page_idx="%d" top="%s" left="%s" name="%s"><tbody>', F.col("page_idx"), F.coalesce(F.col("box.top").cast("string"), F.lit("0")), F.coalesce(F.col("box.left").cast("string"), F.lit("0")), F.col("header_text")))
    row = F.concat(F.when(F.col("is_table_start"), head).otherwise(""), F.lit("<tr "), attributes, F.lit(">"), F.when(F.col("is_row_group"), full).otherwise(F.array_join(cell, "")), F.lit("</tr>"), F.when(F.col("is_table_end"), "</tbody></table>").otherwise(""))
    piece = (
        F.when(F.col("in_table"), row)
        .when(F.col("block_type") == "header", F.concat(F.lit("<h4 "), attributes, F.lit("> "), F.col("block_text"), F.lit(" </h4>")))
        .when(F.col("block_type") == "table_row", F.concat(F.lit("<p "), attributes, F.lit("> "), F.col("block_text"), F.lit(" </p>")))
        .when(F.col("block_type") == "hr", "<hr>")
        .when(F.size("block_sents") == 1, one)
        .otherwise(many)
    )
    pieces = rows.select(*keys, F.struct("block_idx", piece.alias("html")).alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return pieces.select(*keys, F.concat(F.lit(f"<!DOCTYPE html><html><head>{_css()}</head>"), F.array_join(F.col("ps.html"), ""), F.lit("</html>")).alias("html"))
