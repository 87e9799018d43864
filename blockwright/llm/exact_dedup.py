"""Exact duplicates of texts: an immutable snapshot screened by static binary-fuse filters, then byte checks in exact buckets.

A snapshot is written once (build_snapshot) and kept: its digests are dealt into buckets by their last bits, each bucket
with one binary-fuse filter (about nine bits a digest), and beside them the texts by parts of buckets, for byte checks.
Any number of batches can be screened against it without its source being read again.

A batch that comes in is grouped by digest first, so a text with a million copies is one row from there on; its digests
are screened against the filter of their bucket. Digests that the filter rejects are surely new and are only grouped
among themselves; positives are joined to the exact bucket. Wherever several rows share a digest their bytes are
compared, of the snapshot only in parts that a batch hits, and should two texts have one digest they are grouped by text.

No step holds more than one bucket in memory, and the number of buckets grows with the snapshot.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passing, shared_dir, sized, stored, whole_text

#: Digests of the snapshot in a bucket, on average, and parts into which its texts are dealt.
BUCKET_ROWS, PARTS = 8192, 256
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: xor-shift, multiply, twice."""
    x = x + np.uint64((seed * GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A static set of 64-bit keys: 8-bit fingerprints in three neighbouring segments; false positives about 1 in 256, no false negatives."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        offsets = [(x & mask).astype(np.int64) for x in (h, h >> np.uint64(13), mixed(h, 7))]
        places = np.stack([first + i * segment + offset for i, offset in enumerate(offsets)])
        return places, (mixed(h, 3) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(12, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        for seed in range(1, 200):
            count = max(1, math.ceil(n * factor * (1 + seed // 8 * 0.05) / segment) - 2)
            places, prints = cls._places(keys, seed, segment, count)
            order = cls._peel(places, (count + 2) * segment)
            if order is not None:
                cells = np.zeros((count + 2) * segment, np.uint8)
                for who, where in reversed(order):  # keys of one round share no cell that the round sets
                    others = np.bitwise_xor.reduce(np.where(places[:, who] == where, 0, cells[places[:, who]]), axis=0)
                    cells[where] = prints[who] ^ others
                return cls(seed, segment, count, cells)
        raise RuntimeError("no seed peels")

    @staticmethod
    def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the cell that each has for itself); None if a core stays."""
        degree = np.bincount(places.ravel(), minlength=size)
        ids = np.tile(np.arange(places.shape[1], dtype=np.int64), 3)
        owner = np.zeros(size, np.int64)
        np.bitwise_xor.at(owner, places.ravel(), ids)
        rounds, left, front = [], places.shape[1], np.flatnonzero(degree == 1)
        while len(front):
            who, at = np.unique(owner[front], return_index=True)
            rounds.append((who, front[at]))
            left -= len(who)
            touched = places[:, who].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(who, 3))
            touched = np.unique(touched)
            front = touched[degree[touched] == 1]
        return rounds if not left else None

    def __contains__(self, key: int) -> bool:
        return bool(self.hits(np.array([key], np.uint64))[0])

    def hits(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        places, prints = self._places(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return np.bitwise_xor.reduce(self.cells[places], axis=0) == prints


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; runs that are one space already are not touched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest_of(text: Column, bits: int = 256) -> Column:
    """The first bits of the SHA-256 of a normalised text."""
    return F.substring(F.unhex(F.sha2(normalised(text), 256)), 1, bits // 8)


def digested(docs: DataFrame, bits: int = 256) -> DataFrame:
    """doc_id, norm (the normalised text; null counts as empty), digest (bits of SHA-256; tests shorten it to force collisions)."""
    norm = normalised(whole_text())
    return docs.select("doc_id", norm.alias("norm")).select("doc_id", "norm", F.substring(F.unhex(F.sha2("norm", 256)), 1, bits // 8).alias("digest"))


def _key(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, -4, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket that has digests: bucket, seed, segment, count, cells."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(rows["key"].to_numpy().view(np.uint64))
        return pd.DataFrame([[key[0], made.seed, made.segment, made.count, made.cells.tobytes()]], columns=["bucket", "seed", "segment", "count", "cells"])

    keyed = groups.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
    return keyed.groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, count int, cells binary")


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The rows of digests (one a digest) that may be in the snapshot."""

    def probe(_: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(rows):
            return rows[["digest"]].iloc[:0]
        f = found.iloc[0]
        made = FuseFilter(int(f["seed"]), int(f["segment"]), int(f["count"]), np.frombuffer(f["cells"], np.uint8))
        return rows.loc[made.hits(rows["key"].to_numpy().view(np.uint64)), ["digest"]]

    keyed = digests.select("digest", _key(F.col("digest")).alias("key"), _bucket(F.col("digest"), buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


@dataclass(frozen=True)
class Snapshot:
    """A snapshot's folder: ids (doc_id, digest, mark, copies), groups (digest, keep_id, group_size), filters by bucket, texts (digest, norm) by part, clashing digests."""

    path: str
    buckets: int
    bits: int

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")


SCHEMAS = {
    "ids": "doc_id long, digest binary, mark long, copies long",
    "groups": "digest binary, keep_id long, group_size long",
    "filters": "bucket int, seed int, segment int, count int, cells binary",
    "texts": "digest binary, norm string, part int",
    "clashing": "digest binary",
    "manifest": "buckets int, bits int",
}


def _part(digest: Column) -> Column:
    return _bucket(digest, PARTS)


def _counted(hashed: DataFrame) -> DataFrame:
    """doc_id, digest, mark (another hash of the text, for digests that two texts share) and copies; rows that repeat all three are one from here on."""
    return hashed.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "digest", F.xxhash64("norm").alias("mark")).agg(F.count("*").alias("copies"))


def _grouped(ids: DataFrame, *by: str) -> DataFrame:
    return ids.groupBy(*(by or ("digest",))).agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def _several(texts: DataFrame) -> DataFrame:
    """The digests of more than one text."""
    return texts.groupBy("digest").count().filter("count > 1").select("digest")


def build_snapshot(docs: DataFrame, path: str, bits: int = 256) -> Snapshot:
    """Writes the snapshot of documents (doc_id, text) to an empty folder, which is never changed afterwards."""
    spark = docs.sparkSession
    hashed, made = digested(docs, bits), Snapshot(path, 1, bits)
    _counted(hashed).write.parquet(f"{path}/ids")
    _grouped(made.read(spark, "ids")).write.parquet(f"{path}/groups")
    groups = made.read(spark, "groups")
    buckets = max(1, groups.count() // BUCKET_ROWS)
    build_filters(groups, buckets).write.parquet(f"{path}/filters")
    texts = hashed.groupBy("digest", F.xxhash64("norm").alias("mark")).agg(F.first("norm").alias("norm")).withColumn("part", _part(F.col("digest")))
    texts.select("digest", "norm", "part").repartition("part").sortWithinPartitions("part", "digest").write.partitionBy("part").parquet(f"{path}/texts")
    _several(made.read(spark, "ids").select("digest", "mark").distinct()).write.parquet(f"{path}/clashing")
    spark.createDataFrame([(buckets, bits)], SCHEMAS["manifest"]).coalesce(1).write.parquet(f"{path}/manifest")
    return Snapshot(path, buckets, bits)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot that has been built before."""
    buckets, bits = spark.read.schema(SCHEMAS["manifest"]).parquet(f"{path}/manifest").first()
    return Snapshot(path, buckets, bits)


def groups_with(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """The rows of exact_groups() for a snapshot that is kept and a batch (doc_id, text).

    Of the snapshot, filters and digests are read, and texts only in parts in which the batch has a digest of it.
    """
    spark = batch.sparkSession
    hashed, old = digested(batch, snapshot.bits), snapshot.read(spark, "groups")
    new_ids = stored(_counted(hashed), "digests")
    new = stored(_grouped(new_ids), "batch")
    positives = screen(new, snapshot.read(spark, "filters"), snapshot.buckets)
    hits = new.join(positives, "digest").join(old.select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size")), "digest")
    met = stored(hits.select("digest", F.least("keep_id", "old_id").alias("keep_id"), (F.col("group_size") + F.col("old_size")).alias("group_size")), "met")
    alone = old.unionByName(new).join(met.select("digest"), "digest", "left_anti")
    groups = stored(alone.unionByName(met), "groups")

    parts = [r["part"] for r in met.select(_part(F.col("digest")).alias("part")).distinct().collect()]  # PARTS at most
    shared = stored(new.filter("group_size > 1").select("digest").unionByName(met.select("digest")).distinct(), "shared")
    own = hashed.join(sized(shared, 64), "digest", "left_semi").select("digest", "norm")
    theirs = snapshot.read(spark, "texts").filter(F.col("part").isin(parts)).join(sized(met.select("digest"), 64), "digest", "left_semi").select("digest", "norm")
    compared = own.unionByName(theirs).groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clashing = stored(_several(compared).unionByName(snapshot.read(spark, "clashing")).distinct(), "clashing")

    ids = snapshot.read(spark, "ids").unionByName(new_ids).groupBy("doc_id", "digest", "mark").agg(F.sum("copies").alias("copies"))
    out = ["doc_id", "keep_id", "group_size", "copies", "digest"]
    if clashing.isEmpty():
        rows = ids.join(groups, "digest")
    else:  # two texts with one digest: their marks tell them apart
        few = sized(clashing, 64)
        split = ids.join(few, "digest", "left_semi")
        exact = split.join(_grouped(split, "digest", "mark"), ["digest", "mark"])
        rows = ids.join(few, "digest", "left_anti").join(groups, "digest").select(*out).unionByName(exact.select(*out))
    place = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("place")
    return rows.select(*out, place).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "digest")


def exact_groups(snapshot: DataFrame, batch: DataFrame, bits: int = 256) -> DataFrame:
    """Groups of equal texts over a snapshot and a batch that comes in, both with doc_id and text.

    A row for each input row: doc_id, keep_id, group_size, kept, digest. Null texts count as empty, empty texts are equal
    to each other. The smallest doc_id of a group stays; of rows that repeat it, one. Null doc_ids come after all others:
    a group without any other has keep_id null, and one of its rows stays. A long text is one row's work. Empty tables
    give no rows; other columns are never read.
    """
    folder = f"{shared_dir(batch.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    passing(batch.sparkSession, folder)
    return groups_with(build_snapshot(snapshot, folder, bits), batch)


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, once: a snapshot and a batch, by the parity of a hash of doc_id (null: the batch)."""
    even = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
    return docs.filter(even), docs.filter(~even)
