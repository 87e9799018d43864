"""Blocks of documents as they arrive. Parsing knows one document at a time, so a micro-batch is parsed as a table is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import clean_lines


def read_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Parquet files of documents as a stream, at most so many a batch."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files).parquet(path)


def write_blocks(docs: DataFrame, out: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] = clean_lines, **trigger: object) -> StreamingQuery:
    """Writes the blocks of each batch to a folder of its own, so that a batch which is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        parse(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
