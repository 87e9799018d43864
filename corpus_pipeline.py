"""A training corpus from `documents`: quality, exact and near duplicates, source mixing, packed sequences.

Each stage is a function of (spark, docs, sf_dir). It gets what its predecessor kept, read again from Parquet, and all but
the last return rows of `documents` unchanged, with the same columns. Stages read doc_id, text, source and lang; other
columns only pass through, whatever their names.

A stage's result may read what the stage has written to the shared folder. That is deleted when the next stage begins,
since by then the result itself is on disk; tables that others have written are never touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.llm import exact_dedup, mixing, ngram_join, packing, quality, queries
from blockwright.llm.common import owned, release, sized, stored, table, whole_text

#: Of the tokens that reach the mixing stage, the share that it draws.
BUDGET = 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders that the stage before has written.
_before: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage that deletes its predecessor's intermediate tables, and none else, before it begins."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _before)
        with owned(_before):
            return f(spark, docs, sf_dir)

    return run_stage


def without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """docs but for the rows whose doc_id and key are in dropped (doc_id, key): of rows that share an id, only those meant go."""
    gone = dropped.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    gone = stored(gone, "dropped")
    return docs.join(sized(gone, 64), docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that nearest-neighbour voting scores below quality.GOOD.

    Null and empty texts have score 0 and go; null ids are judged by their text; repeated rows stay or go together. An
    empty table, or labels without any usable row, leave nothing.
    """
    score = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score >= quality.GOOD)


@stage
def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts, and one of rows that repeat both.

    A null text is equal to an empty one; a null id is larger than all others. An empty table stays empty.
    """
    groups = stored(exact_dedup.exact_groups(*exact_dedup.halves(docs)), "kept")
    digest = exact_dedup.digest_of(whole_text())
    left = without(docs, groups.filter("not (doc_id <=> keep_id)").select("doc_id", F.col("digest").alias("key")), digest)
    if groups.filter("not kept and doc_id <=> keep_id").isEmpty():
        return left
    return left.withColumn("__digest", digest).dropDuplicates(["doc_id", "__digest"]).drop("__digest")


@stage
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near duplicates (all of a component in which none has an id).

    Texts without words are no one's copies. An empty table stays empty.
    """
    dropped = ngram_join.near_groups(docs).filter("not (doc_id <=> component_id)")
    return without(docs, dropped.select("doc_id", F.col("text_hash").alias("key")), F.xxhash64(whole_text()))


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by probabilities raked to source, language and topic targets.

    A null source or language counts as an empty one; equal ids (null ones, too) are drawn together. An empty table
    stays empty.
    """
    return mixing.mix(docs, budget=BUDGET).filter("selected").select("d.*")


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of at most packing.CAPACITY tokens.

    A null text is the end id alone; null and repeated ids are packed row by row; a long text is cut. An empty table
    gives no rows.
    """
    return packing.placed(packing.pack(docs, *queries.tokenizer_files()))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("exact_dedup", one_of_each_text),
    ("ngram_join", one_of_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Votes, raking and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over its predecessor's rows as written to the shared folder; a stage's rows go once the next one's are written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, each in STAGES[:-1]:
        made, now = each(spark, docs, sf_dir), []
        with owned(now):
            docs = stored(made, name)
        release(spark, last)
        last = now
    return STAGES[-1][1](spark, docs, sf_dir)
