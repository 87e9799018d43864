"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hash of each prefix, modulo two primes. From it follow, without reading the text again,
the hash of any span (so whether two spans are equal) and, by binary search, the longest common extension of two
places. The fingerprint is the SKETCH smallest of the hashes of all spans of WINDOW code points: equal texts have equal
ones, and the share that two fingerprints have in common estimates the Jaccard likeness of the texts' spans.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_batches, whole_text

WINDOW = 8
SKETCH = 64
#: Two primes below 2^31 and a base for each; sums of 2^32 terms still fit in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1140671485, 764261123)

#: Powers that a worker keeps; those of longer texts are made for them and dropped.
KEPT = 1 << 20
#: Code points that are hashed at a time.
CHUNK = 1 << 18

_powers: list[np.ndarray] = [np.ones(1, np.uint32)] * 4


def powers(n: int) -> list[np.ndarray]:
    """base^i and base^-i for i up to n, modulo each prime."""
    global _powers
    if len(_powers[0]) > n:
        return _powers
    size, out = (1 << (n + 1).bit_length() if n < KEPT else n + 1), []
    for base, p in ((pow(b, sign, p), p) for sign in (1, -1) for b, p in zip(BASES, PRIMES, strict=True)):
        have = np.ones(size, np.uint32)
        done = 1
        while done < size:
            more = min(done, size - done)
            step = np.uint64(pow(base, done, p))
            for at in range(0, more, CHUNK):
                to = min(at + CHUNK, more)
                have[done + at : done + to] = have[at:to].astype(np.uint64) * step % np.uint64(p)
            done += more
        out.append(have)
    if n < KEPT:
        _powers = out
    return out


class PrefixHash:
    """The prefix arrays of a text: 8 bytes a code point, and 16 of powers beside them while it is worked on."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = n = len(codes)
        self.by = powers(n)
        self.arrays = []
        for by, p in zip(self.by, PRIMES, strict=False):
            sums, before = np.zeros(n + 1, np.uint32), 0
            for at in range(0, n, CHUNK):
                part = (codes[at : at + CHUNK].astype(np.uint64) + np.uint64(1)) * by[at : min(at + CHUNK, n)] % np.uint64(p)
                sums[at + 1 : at + 1 + len(part)] = (np.cumsum(part) + np.uint64(before)) % np.uint64(p)
                before = int(sums[at + len(part)])
            self.arrays.append(sums)

    def span(self, begin: int, length: int) -> tuple[int, ...]:
        """The hash of a span, wherever it stands."""
        return tuple((int(a[begin + length]) - int(a[begin])) % p * int(self.by[k + 2][begin]) % p for k, (a, p) in enumerate(zip(self.arrays, PRIMES, strict=True)))

    def spans(self, length: int) -> Iterator[np.ndarray]:
        """The 64-bit hashes of all spans of a length, so many at a time."""
        m = self.n - length + 1
        for at in range(0, m, CHUNK):
            to = min(at + CHUNK, m)
            both = [(a[at + length : to + length].astype(np.uint64) + np.uint64(p) - a[at:to]) % np.uint64(p) * self.by[k + 2][at:to] % np.uint64(p) for k, (a, p) in enumerate(zip(self.arrays, PRIMES, strict=True))]
            h = (both[0] << np.uint64(31) ^ both[1]) * np.uint64(0x9E3779B97F4A7C15)
            yield (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def equal_spans(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, length) == b.span(j, length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """How many code points from i in a and from j in b are the same."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _smallest(values: np.ndarray) -> np.ndarray:
    """The SKETCH smallest that differ, ascending."""
    if len(values) > 8 * SKETCH:  # repeated spans must not fill the sketch: doubled until enough differ
        take = 2 * SKETCH
        while take < len(values):
            found = np.unique(np.partition(values, take)[:take])
            if len(found) >= SKETCH:
                return found[:SKETCH]
            take *= 4
    return np.unique(values)[:SKETCH]


def sketch(h: PrefixHash) -> np.ndarray:
    """The SKETCH smallest 32-bit span hashes, ascending; a shorter text is one span, an empty one has none."""
    out = np.zeros(0, np.uint32)
    for values in h.spans(min(WINDOW, h.n)) if h.n else ():
        out = _smallest(np.concatenate([out, (values >> np.uint64(32)).astype(np.uint32)]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sketches: the share of the smallest of their union that stands in both; of two empty ones, 1."""
    union = np.union1d(a, b)
    if len(a) == SKETCH or len(b) == SKETCH:
        union = union[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()) if len(union) else 1.0


def hexed(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many of the first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt into ranges of the order, each with a copy of the next range's first row (ghost) behind it; the number of partitions.

    The order is doc_id (nulls first), then a hash of the text. Ranges are quantiles of doc_id; an id that fills several
    of them, as null ids may, has ranges of its own, by the hash. Texts move once; the first rows are found from doc_id
    alone (and the hash of such ids); there are as many as ranges.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nulls, total = ids.agg(F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    found = np.array(ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) or [], np.float64).astype(np.int64)
    values, times = np.unique(found, return_counts=True)
    heavy = dict(zip(values[times > 1].tolist(), (times[times > 1] + 1).tolist(), strict=True))
    cuts = np.unique(np.concatenate([values, [i + 1 for i in heavy]]).astype(np.int64)) if len(values) else values
    null_ranges = max(1, math.ceil(nulls * ranges / max(total, 1)))

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna().to_numpy()
        out = np.zeros(len(doc_id), np.int32)
        out[known] = 1 + np.searchsorted(cuts, doc_id[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    several = F.when(F.col("doc_id").isNull(), null_ranges).otherwise(1)
    for i, n in heavy.items():  # at most as many as ranges
        several = F.when(F.col("doc_id") == i, n).otherwise(several)
    hashed = F.xxhash64(whole_text())
    share = F.floor((F.shiftrightunsigned(hashed, 32) / float(1 << 32)) * several)
    inner = F.when(several > 1, share).otherwise(0) if heavy or null_ranges > 1 else F.lit(0)  # without such ids the texts aren't read here
    order = F.shiftrightunsigned(hashed, 32)
    part = (range_of("doc_id").cast("long") * F.lit(1 << 20) + inner).alias("part")
    own_hash = (F.when(several > 1, order) if heavy or null_ranges > 1 else F.lit(None).cast("long")).alias("h")
    first = ids.select("doc_id", part, own_hash).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("head")).collect()  # a row for each range
    heads = sorted((r["part"], r["head"]["doc_id"], r["head"]["h"]) for r in first)
    rows = ids.select("doc_id", whole_text().alias("text"), part, order.alias("h"))
    if not heads:
        return rows.withColumn("ghost", F.lit(False)), parts
    own = F.struct(F.col("part"), F.lit(False).alias("ghost"))
    before = [(d is not None, d or 0, h, heads[k - 1][0], p) for k, (p, d, h) in enumerate(heads)]
    to = spark.createDataFrame(before, "known boolean, head long, head_h long, before long, head_part long")
    same = (F.col("known") == F.col("doc_id").isNotNull()) & (F.col("head") == F.coalesce("doc_id", F.lit(0))) & (F.col("head_part") == F.col("part")) & (F.col("head_h").isNull() | (F.col("head_h") == F.col("h")))
    rows = rows.join(F.broadcast(to) if len(heads) * 40 <= BROADCAST_BYTES else to, same, "left")
    copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("ghost"))))
    return rows.select("doc_id", "text", "h", F.explode(copies).alias("to")).select("doc_id", "text", "h", "to.part", "to.ghost"), parts


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, same_next long"


def fingerprint(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text): its fingerprint, its edited text's, and how like they and the next document's are.

    Documents follow one another by doc_id (nulls first), equal ids by a hash of the text and the text; a single document
    follows itself. Null texts count as empty, and an empty text is like another empty one only. common_prefix is the
    longest common extension of a text and its edited form from their beginnings, same_next that of a text and the next
    document's. A long text takes some 50 bytes a code point while it is worked on. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    arrow_batches(docs.sparkSession)
    rows, parts = with_next(docs)
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").asc_nulls_first(), "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose successor comes next: part, doc_id, text, its prefix arrays and sketch
        for batch in batches:
            out = []
            for doc_id, text, part, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and last[0] != part:
                    last = None
                h = PrefixHash(text)
                s = sketch(h)
                if last:
                    _, before, old, old_h, old_s = last
                    new = edited(old, text)
                    new_h = PrefixHash(new)
                    new_s = sketch(new_h)
                    out.append((before, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), hexed(old_s), hexed(new_s), likeness(old_s, new_s), likeness(old_s, s), common_extension(old_h, 0, new_h, 0), common_extension(old_h, 0, h, 0)))
                last = None if ghost else (part, doc_id, text, h, s)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 9, types, strict=True)], names=names)

    return dealt.mapInArrow(run, SCHEMA)
