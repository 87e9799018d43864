"""What the operators share: intermediate tables in the cluster's shared folder, size-checked semi-joins, text clean-up."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast sides are counted first and go out only below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes in an Arrow batch handed to Python, whichever is reached first: long texts come in small batches.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

#: Where stored() notes its paths while someone owns them.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (tests) gets a folder of this machine; on a cluster that is an error, since
    executors would write to disks of their own.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not (found := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="blockwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def passing(spark: SparkSession, path: str) -> None:
    """A folder that is deleted when the driver's session ends, or before by the owner in whose owned() block this is called."""
    files, made = _hadoop(spark, path)
    files.mkdirs(made)
    files.deleteOnExit(made)
    if (owned_by := _owner.get()) is not None:
        owned_by.append(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage is cut, and a lost executor costs nothing already written. The folder is passing()."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    passing(spark, folder)
    df.write.parquet(f"{folder}/rows")
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@contextmanager
def owned(paths: list[str]) -> Iterator[None]:
    """Within the block, the paths that stored() writes are noted in the caller's list, for release()."""
    token = _owner.set(paths)
    try:
        yield
    finally:
        _owner.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that the caller owns and whose results are on disk elsewhere by now."""
    while paths:
        files, made = _hadoop(spark, paths.pop())
        files.delete(made, True)


def arrow_batches(spark: SparkSession) -> None:
    """Bounds every Arrow batch of the session by rows and bytes; the same for all operators, so their order doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sized(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its counted rows fit in BROADCAST_BYTES, else as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df
