"""Queries over plain text: lines, their kinds, blocks, headers and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, features, lines
from . import line_sql
from .tables import table

COUNTS = ["word_count", "title_word_count", "alpha_count", "number_count", "dollar_count", "pct_count", "date_entry_count", "stop_word_count", "eff_word_count"]
FLAGS = ["numbered_line", "is_zipcode_or_po", "is_list_item", "is_header", "is_table_row", "ends_with_period", "incomplete_line", "continuing_line"]


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.exploded(table(spark, sf_dir, "documents"))
    return features.line_features(kept)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long"), "line", (F.length("line") > 2).alias("kept"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.kept_lines(lines.split_lines(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", F.col("line_no").cast("long"), "line")


def line_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).select("doc_id", "line", *(F.col(c).cast("long").alias(c) for c in COUNTS))


def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).select("doc_id", "line", "line_type", *FLAGS)


def line_type_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.exploded(table(spark, sf_dir, "documents"), keys=("doc_id", "lang"))
    typed = features.line_features(kept)
    return typed.groupBy("lang", "line_type").agg(F.count("*").alias("n_lines"), F.sum("word_count").alias("n_words"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.clean_lines(table(spark, sf_dir, "documents"))


def block_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.with_headers(blocks.clean_lines(table(spark, sf_dir, "documents"))).select("doc_id", "block_idx", "block_type", "header_block_idx", "header_text")


def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.titles(blocks.clean_lines(table(spark, sf_dir, "documents")))


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.clean_lines(table(spark, sf_dir, "conversations"), keys=("conv_id", "turn"))


def line_noun_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.exploded(table(spark, sf_dir, "documents"))
    return features.line_features(kept, chunks=True).select("doc_id", "line_no", "noun_chunks", "quoted_words")


QUERIES = {f.__name__: f for f in (line_noun_chunks, text_lines, line_dedup, line_counters, line_types, line_type_by_lang, text_blocks, block_headers, doc_title, conversation_blocks)}

_LINES = "WITH " + line_sql.lines()
_TYPED = f"{_LINES}, {line_sql.features()}"
_BLOCKS = f"{_TYPED}, {line_sql.blocks()}"
_HEADER = "coalesce(last_value(CASE WHEN block_type = 'header' THEN {} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING), {})"
ORACLES = {
    "text_lines": f"{_LINES} SELECT doc_id, n AS line_no, line, length(line) > 2 AS kept FROM lines",
    "line_dedup": f"{_LINES} SELECT doc_id, n AS line_no, line FROM kept",
    "line_counters": f"{_TYPED} SELECT doc_id, line, {', '.join(COUNTS)} FROM typed",
    "line_types": f"{_TYPED} SELECT doc_id, line, line_type, {', '.join(FLAGS)} FROM typed",
    "line_type_by_lang": f"{_TYPED} SELECT lang, line_type, count(*) AS n_lines, sum(word_count)::BIGINT AS n_words FROM typed JOIN documents USING (doc_id) GROUP BY lang, line_type",
    "text_blocks": f"{_BLOCKS} SELECT doc_id, block_idx, block_text, block_type, header_block_idx FROM blocks",
    "block_headers": f"{_BLOCKS} SELECT doc_id, block_idx, block_type, {_HEADER.format('block_idx', -1)} AS header_block_idx, {_HEADER.format('block_text', "''")} AS header_text FROM blocks WHERE block_text <> ''",
    "doc_title": f"{_BLOCKS} SELECT doc_id, CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title FROM (SELECT doc_id, arg_min(block_text, block_idx) AS t FROM blocks GROUP BY doc_id)",
    "conversation_blocks": f"WITH {line_sql.lines('conversations', 'conv_id, turn')}, {line_sql.features('conv_id, turn')}, {line_sql.blocks('conv_id, turn')} SELECT conv_id, turn, block_idx, block_text, block_type, header_block_idx FROM blocks",
}
