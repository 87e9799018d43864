"""Exact Jaccard self-join of five-word shingle sets by parity sketches, and the groups that its links make.

A document's tokens are 64-bit hashes of its shingles. Its sketch has words, by the leading bits of a token's hash; each
word is the XOR of its tokens. A token in one of two sets only changes one word, so the number of words in which two
sketches differ is at most the symmetric difference. For a Jaccard of T that is at most (1-T)/(1+T) of the summed sizes,
so with sizes a <= b <= a/T at most k = a(1/T - 1).

Pigeonhole: of any order over all words, the first word that two sketches share is among the first k + 1 words of both,
since the words before it differ and there are at most k of those. So each sketch gives its first k + 1 words as join
keys; common words, found over the whole corpus, come last in the order. The number of words depends on the size band,
and sizes that can have partners in the next band give keys there too. Pairs that share a key are screened by a second
sketch of one bit a token (XOR-folded to the smaller one's length; its Hamming distance is a lower bound, too) and then
verified on the sets.

Equal sets are one class throughout; a class is known by a 64-bit hash, and where a second one tells two sets with the
same number apart, they get numbers of their own. Candidates are never all pairs of those that share a key: first each
is compared to the smallest of them, then only those whose components still differ are compared to each other. Where
more of these pairs pass the screen than classes meet, the pairs are not written out: the meeting gets the sets
themselves, nearest pairs are verified first, and what is joined by then is not compared. It gives fewer links than it
has classes. A key that very many classes have is dealt over several tasks, and so are the classes around one center.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, sized, stored, whole_text
from .graph import components

WORDS = 5
THRESHOLD = Fraction(3, 4)
#: Sets below this size have a word for each token. Bands above are BAND times as wide; their sketch has three quarters as
#: many words as the band's largest set has tokens. Fewer words than the pigeonhole needs are then ten deviations away.
SMALL, BAND = 64, 4
#: A word in this share of a partition's documents counts as common and comes last; and in so many documents at least.
COMMON_SHARE, COMMON_LEAST = 1 / 2000, 4
#: Common words kept, the most frequent ones; the order of words decides the cost, never the result.
COMMON_MOST = 1 << 20
#: Keys that one task of the join holds, on average, and the bytes of each: 5 of the key, 8 of the class.
BUCKET_KEYS = 1 << 20
#: Words that a Python worker holds at a time while it reads documents.
HELD = 1 << 20
#: Classes in a row of those that share a key.
CHUNK = 1024
#: Classes around one center that are compared in one task; more are dealt in blocks: each by itself, then two by two.
BLOCK = 512
#: Screened pairs for each class of a meeting, at most; meetings with more verify them on the spot.
PAIRS = 2
#: Powers that a worker keeps; those of longer texts are made for them and dropped.
KEPT = 1 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PRIME = np.uint64(0x9E3779B185EBCA87)


_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_IN_WORD = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """The powers of PRIME and of its inverse modulo 2^64, n at least."""
    global _powers
    now = _powers
    while len(now[0]) < n:
        now = [np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))]) for base, have in zip((int(PRIME), pow(int(PRIME), -1, 1 << 64)), now, strict=True)]
    if len(now[0]) <= KEPT:
        _powers = now
    return now


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case: sums of random byte values by powers, and spans as differences of sums."""
    b = np.frombuffer(text.translate(LOWER), np.uint8)
    edges = np.flatnonzero(np.diff(_IN_WORD[b], prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    powers, inverse = _grown(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * powers[: len(b)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * inverse[begin])


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64((0xD6E8FEB86659FD93 + 2 * seed) & 0xFFFFFFFFFFFFFFFF)
    return x ^ (x >> np.uint64(32))


def tokens(text: bytes, width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer words than width, one of them all; of none, none."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = out * PRIME + h[i : i + n]
    out = mixed(out)
    out.sort()
    fresh = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=fresh[1:])
    return out[fresh]


def class_of(found: np.ndarray) -> int:
    """A signed 64-bit number of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


class Classes:
    """Numbers of sets: class_of(), or for a number that several sets have one of both their hashes. mask shortens the first (tests force collisions)."""

    def __init__(self, shared: frozenset[int] = frozenset(), mask: int = -1):
        self.shared, self.mask = shared, mask

    def check(self, found: np.ndarray) -> int:
        return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), 1)).view(np.int64))

    def own(self, number: int, check: int) -> int:
        return int(np.uint64(xxhash.xxh3_64_intdigest(b"%d %d" % (number, check))).view(np.int64))

    def __call__(self, found: np.ndarray) -> int:
        number = class_of(found) & self.mask
        return self.own(number, self.check(found)) if number in self.shared else number


def bits(found: np.ndarray) -> bytes:
    """The parity sketch of one bit a token: as many bits as the next power of two above twice the set's size, 64 at least."""
    size = max(64, 2 << int(len(found)).bit_length())
    odd = np.bincount((mixed(found, 1) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of two bit sketches, the longer one folded by XOR."""
    x, y = (np.frombuffer(s, np.uint8) for s in sorted((a, b), key=len))
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def bands(n: int, threshold: Fraction = THRESHOLD) -> list[int]:
    """The numbers of words of the sketches that a set of this size needs: 0 is a word for each token."""
    top, count = SMALL, 0
    while n >= top:
        top, count = top * BAND, top * BAND * 3 // 4
    return [count] if n < top * threshold else [count, top * BAND * 3 // 4]


def sketch_words(found: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """The words of a sketch as keys: the XOR of the tokens of each, mixed with its number and the band's."""
    if not count:
        return mixed(found, 2 + seed)
    if seed:
        found = np.sort(mixed(found, 3 + seed))
    place = (found >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)  # ascending, as the tokens are
    at = np.flatnonzero(np.diff(place, prepend=place[:1] + np.uint64(1)))
    words = np.bitwise_xor.reduceat(found, at)
    return mixed(words * PRIME + place[at] + np.uint64(count << 32), 4)


def most_apart(n: int, threshold: Fraction = THRESHOLD) -> int:
    """The largest symmetric difference of a set of this size to any set that it links with: n(1/T - 1) for a partner of n/T."""
    return int(n * (1 / threshold - 1))


def keys(found: np.ndarray, common: np.ndarray, threshold: Fraction = THRESHOLD, seed: int = 0) -> np.ndarray:
    """The join keys of a set: the first most_apart + 1 words of each sketch, common ones last."""
    out, need = [], most_apart(len(found), threshold) + 1
    for count in bands(len(found), threshold):
        words = sketch_words(found, count, seed)
        if len(words) > need:
            late = np.zeros(len(words), bool)
            if len(common):
                at = np.minimum(np.searchsorted(common, words), len(common) - 1)
                late = common[at] == words
            words = words[np.lexsort((words, late))[:need]]
        out.append(words)
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same * threshold.denominator >= threshold.numerator * (len(a) + len(b) - same)


def possible(n: int, a: bytes, m: int, b: bytes, threshold: Fraction = THRESHOLD) -> bool:
    """Whether sizes and bit sketches leave room for a link."""
    t = threshold
    return min(n, m) * t.denominator >= max(n, m) * t.numerator and distance(a, b) * (t.denominator + t.numerator) <= (t.denominator - t.numerator) * (n + m)


def _sets(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", whole_text().cast("binary").alias("text"))


def summaries(docs: DataFrame, threshold: Fraction, seed: int, classes: Classes) -> DataFrame:
    """A row for each document: doc_id, text_hash, node (its class), check (another hash of its set), n, bits, short (words that its sketch lacks); and rows (word, count) of words common in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, documents = [], 0
        seen, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def settle() -> None:
            nonlocal seen, counts
            if pending:
                values, n = np.unique(np.concatenate(pending), return_counts=True)
                both, at = np.unique(np.concatenate([seen, values[n > 1]]), return_inverse=True)
                seen, counts = both, np.bincount(at, np.concatenate([counts, n[n > 1]]), len(both)).astype(np.int64)
                pending.clear()

        waiting = 0
        for batch in batches:
            nodes, checks, sizes, parity, short = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = tokens(text)
                sizes.append(len(found))
                nodes.append(classes(found))
                checks.append(classes.check(found))
                parity.append(bits(found))
                lacks = 0
                for count in bands(len(found), threshold) if len(found) else []:
                    words = sketch_words(found, count, seed)
                    lacks = max(lacks, most_apart(len(found), threshold) + 1 - len(words))
                    pending.append(words)
                    waiting += len(words)
                short.append(lacks)
                documents += 1
            if waiting > HELD:
                settle()
                waiting = 0
            k = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parity, pa.binary()), pa.array(short, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        settle()
        least = max(COMMON_LEAST, documents * COMMON_SHARE)
        many = counts >= least
        k, words = int(many.sum()), seen[many].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.array(words), pa.array(counts[many], pa.int64())], names=names)

    names = ["doc_id", "text_hash", "node", "check", "n", "bits", "short", "word", "count"]
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).select("doc_id", F.col("text").cast("binary"), F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, node long, check long, n int, bits binary, short int, word long, count long")


def key_blocks(docs: DataFrame, common: np.ndarray, heavy: dict[int, int], buckets: int, threshold: Fraction, seed: int, classes: Classes) -> DataFrame:
    """The keys of all sets, packed: bucket, block (13 bytes a key: its low 40 bits, the class).

    A heavy key's classes are dealt over as many buckets as heavy says, numbered from buckets on.
    """
    weighty = np.sort(np.array(list(heavy), np.uint64))
    shares = np.array([heavy[int(w)] for w in weighty], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[int] = []

        def packed() -> pa.RecordBatch:
            words = np.concatenate(held)
            rows = np.empty(len(words), [("key", "V5"), ("node", "<i8")])
            rows["key"] = np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").ravel()
            rows["node"] = np.repeat(np.array(owners, np.int64), [len(w) for w in held])
            to = ((words >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            if len(weighty):
                at = np.minimum(np.searchsorted(weighty, words), len(weighty) - 1)
                is_heavy = weighty[at] == words
                spread = mixed(rows["node"].astype(np.uint64), 5) % shares[at]
                to = np.where(is_heavy, buckets + ((words >> np.uint64(40)) + spread * PRIME) % np.uint64(buckets), to).astype(np.int32)
            order = np.argsort(to, kind="stable")
            rows, ends = rows[order], np.flatnonzero(np.diff(to[order], append=-1)) + 1
            held.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(to[order][ends - 1]), pa.array([p.tobytes() for p in np.split(rows, ends[:-1])], pa.binary())], names=["bucket", "block"])

        waiting = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = tokens(text)
                if len(found):
                    held.append(keys(found, common, threshold, seed))
                    owners.append(classes(found))
                    waiting += len(held[-1])
            if waiting > HELD:
                yield packed()
                waiting = 0
        if held:
            yield packed()

    return _sets(docs).mapInArrow(run, "bucket int, block binary")


def _by_key(bucket: list[bytes], alone: bool) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct classes, ascending, of each key of a bucket that has several (alone: or one)."""
    rows = np.frombuffer(b"".join(bucket), [("key", "V5"), ("node", "<i8")])
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :5] = rows["key"].copy().view(np.uint8).reshape(-1, 5)
    key, node = wide.view(np.uint64).ravel(), rows["node"]
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    if not alone:
        again = np.zeros(len(key) + 1, bool)
        again[1:-1] = key[1:] == key[:-1]
        mine = again[:-1] | again[1:]  # keys that come once can't join
        key, node = key[mine], node[mine]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[fresh], node[fresh]
    begins = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=False):
        if alone or b - a > 1:
            yield int(key[a]), node[a:b]


def runs(blocks: DataFrame, buckets: int) -> DataFrame:
    """Classes that share a key: run (a number of the whole list), chunk, center (its smallest class), nodes (CHUNK at most). Equal lists count once.

    A heavy key's list comes in as many parts as it has buckets; its chunks are numbered and its center is found over
    all parts afterwards.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(number: int, bucket: list[bytes]) -> Iterator[tuple]:
            heavy, seen = number >= buckets, set()
            for key, nodes in _by_key(bucket, heavy):
                run = key if heavy else class_of(nodes)
                if heavy or run not in seen:
                    seen.add(run)
                    yield from ((heavy, run, i, int(nodes[0]), nodes[at : at + CHUNK].tolist()) for i, at in enumerate(range(0, len(nodes), CHUNK)))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names=["heavy", "run", "chunk", "center", "nodes"])

        now, held, rows = None, [], []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    rows += one(now, held) if held else ()
                    now, held = bucket, []
                    if len(rows) > 2000:
                        yield out(rows)
                        rows = []
                held.append(block)
        rows += one(now, held) if held else ()
        yield out(rows)

    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(find, "heavy boolean, run long, chunk int, center long, nodes array<long>")


def whole_runs(parts: DataFrame) -> DataFrame:
    """The parts of runs() as run, chunk, center, nodes; a heavy key's as one list. Its windows see a number a chunk, not the classes."""
    light = parts.filter("not heavy").drop("heavy").dropDuplicates(["run", "chunk", "center"])
    heavy = parts.filter("heavy").withColumn("first", F.get("nodes", F.lit(0)))
    one = Window.partitionBy("run")
    placed = heavy.select("run", "first").withColumn("chunk", (F.row_number().over(one.orderBy("first")) - 1).cast("int")).withColumn("center", F.min("first").over(one))
    several = placed.withColumn("chunks", F.count("*").over(one))
    return light.unionByName(heavy.select("run", "first", "nodes").join(several, ["run", "first"]).filter("chunks > 1 or size(nodes) > 1").select("run", "chunk", "center", "nodes"))


def screened(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of classes whose sizes, and then bit sketches, leave room for a link."""
    t = threshold

    def side(pairs: DataFrame, name: str, column: str) -> DataFrame:
        return pairs.join(nodes.select(F.col("node").alias(name), F.col(column).alias(f"{column}_{name}")), name)

    sizes = side(side(pairs, "a", "n"), "b", "n").filter(F.least("n_a", "n_b") * t.denominator >= F.greatest("n_a", "n_b") * t.numerator)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([possible(n, x, m, y, threshold) for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)], pa.bool_())).select([0, 1])

    return side(side(sizes, "a", "bits"), "b", "bits").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(screen, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: Fraction, classes: Classes) -> DataFrame:
    """The pairs (a, b) of classes that link, by their sets; only texts of classes in a pair are read for them."""
    left = stored(pairs, "pairs")
    sets = sets_of(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, classes)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    both = left.join(sets.select(F.col("node").alias("b"), F.col("found").alias("found_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("found").alias("found_a")), "a")
    return stored(both.select("a", "b", "found_a", "found_b").mapInArrow(verify, "a long, b long"), "links")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, classes: Classes) -> DataFrame:
    """node and found (its sorted tokens) of the classes wanted (node); only their texts are read."""
    involved = stored(wanted.join(nodes.select("node", "doc_id"), "node"), "involved")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([classes(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "found"])

    ids = involved.select("doc_id").distinct()
    texts = docs.join(sized(ids, 16), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    return stored(_sets(texts).select("text").mapInArrow(gather, "node long, found binary").join(sized(involved.select(F.col("node").alias("own")), 16), F.col("node") == F.col("own"), "left_semi").dropDuplicates(["node"]), "sets")


def within(found: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: Fraction, classes: Classes) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes that share a key and are in different components so far, as many as join those of a block that links join; and the lists that have more to compare, for across().

    Lists are taken by their center, so that classes which share many keys meet once and not once a key; a center has no
    more lists than keys. Lists of two are left out: their pair has been compared. Each class around a center is in one
    block only, whatever their number. Of lists longer than CHUNK, each chunk is for itself here.
    """
    to = groups.select("node", "component")
    members = found.select("run", "chunk", F.explode("nodes").alias("node")).join(to, "node", "left").select("run", "chunk", F.coalesce("component", "node").alias("component"))
    by_run = members.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("chunk").alias("chunks"), F.count("*").alias("n"))
    lists = stored(found.join(by_run.filter("low <> high and n > 2").select("run", "chunks"), "run").select("center", "run", "chunk", "chunks", "nodes"), "lists")
    around = lists.select("center", "chunk", F.explode("nodes").alias("node")).distinct().groupBy("center", "chunk").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    lists = lists.join(sized(stored(around, "around"), 24), ["center", "chunk"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = lists.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = F.filter("nodes", lambda n: F.pmod(F.xxhash64(n), F.col("blocks")) == F.col("p"))
    dealt = dealt.select("center", F.col("chunk").alias("i"), F.col("chunk").alias("j"), "p", F.col("p").alias("q"), "run", F.lit(0).alias("side"), mine.alias("nodes")).filter("size(nodes) > 1")
    return met(stored(dealt, "lists"), to, nodes, docs, threshold, classes), lists.filter("blocks > 1 or chunks > 0").select("center", "run", "chunk", "blocks", "nodes")


def across(found: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: Fraction, classes: Classes) -> DataFrame:
    """The links (a, b) that join what within() left apart, of its lists (center, run, chunk, nodes; blocks that the chunk was dealt in).

    Blocks around a center, and chunks of a list, meet two by two. Classes in the center's component by now have blocks
    of their own, which do not meet each other: where all but a few classes of a group are joined, each of these meets
    those few only.
    """
    to = groups.select("node", "component")
    home = found.join(to.select(F.col("node").alias("center"), F.col("component").alias("home")), "center", "left")
    members = home.select("center", "run", "chunk", "blocks", F.coalesce("home", "center").alias("home"), F.explode("nodes").alias("node")).join(to, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = F.col("component") == F.col("home")
    halves = members.groupBy("center", "run", "chunk", "blocks").agg(F.collect_list(F.when(own, F.col("node"))).alias("inner"), F.collect_list(F.when(~own, F.col("node"))).alias("outer"), F.min("component").alias("low"), F.max("component").alias("high"))
    halves = stored(halves, "lists")
    by_run = halves.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("chunk").alias("chunks"))
    lists = halves.join(by_run.filter("low <> high").select("run", "chunks"), "run").withColumn("other", F.explode(F.sequence(F.lit(0), "chunks"))).filter("blocks > 1 or other <> chunk")
    lists = stored(lists.select("center", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "run", "chunk", "inner", "outer"), "lists")
    marked = F.concat(F.transform("inner", lambda n: F.struct(n.alias("node"), F.lit(True).alias("own"))), F.transform("outer", lambda n: F.struct(n.alias("node"), F.lit(False).alias("own"))))
    where = ["center", "i", "j"]
    around = lists.select(*where, F.explode(marked).alias("x")).select(*where, "x.*").distinct().groupBy(*where).agg(F.count("*").alias("n"), F.ceil(F.count_if("own") / BLOCK).cast("int").alias("a"), F.ceil(F.count_if(~F.col("own")) / BLOCK).cast("int").alias("b"))
    dealt = lists.join(sized(stored(around.filter(F.col("n") > BLOCK).drop("n"), "around"), 40), where, "left")
    dealt = dealt.withColumn("a", F.coalesce("a", F.lit(0))).withColumn("b", F.coalesce("b", F.lit(1)))  # few classes: all in one block
    ends = F.sequence(F.lit(0), F.col("a") + F.col("b") - 1)
    pairs = F.flatten(F.transform(ends, lambda p: F.transform(ends, lambda q: F.struct(p.alias("p"), q.alias("q")))))
    two = F.filter(pairs, lambda x: ((F.col("i") < F.col("j")) | (x["p"] <= x["q"])) & (F.greatest(x["p"], x["q"]) >= F.col("a")))  # blocks that meet
    dealt = dealt.withColumn("x", F.explode(two)).select(*where, "x.p", "x.q", "run", "chunk", "inner", "outer", "a", "b")

    def of(block: Column) -> Column:
        in_block = lambda number, blocks: lambda n: F.pmod(F.xxhash64(n), F.greatest(blocks, F.lit(1))) == number
        outer = F.when(F.col("a") == 0, F.concat("inner", "outer")).otherwise(F.col("outer"))
        return F.when(block < F.col("a"), F.filter("inner", in_block(block, F.col("a")))).otherwise(F.filter(outer, in_block(block - F.col("a"), F.col("b"))))

    one_side = F.array(F.struct(F.lit(0).alias("side"), of(F.col("p")).alias("nodes")))
    both_sides = F.array(F.struct(F.lit(0).alias("side"), of(F.col("p")).alias("nodes")), F.struct(F.lit(1).alias("side"), of(F.col("q")).alias("nodes")))
    sides = F.when((F.col("i") == F.col("j")) & (F.col("p") == F.col("q")), one_side).when(F.col("i") == F.col("j"), both_sides).when(F.col("chunk") == F.col("i"), one_side).otherwise(F.slice(both_sides, 2, 1))
    dealt = dealt.withColumn("sides", sides).filter(~F.exists("sides", lambda s: F.size(s["nodes"]) == 0))
    return met(stored(dealt.select(*where, "p", "q", "run", F.inline("sides")), "lists"), to, nodes, docs, threshold, classes)


def met(dealt: DataFrame, to: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: Fraction, classes: Classes) -> DataFrame:
    """Links (a, b) of meetings, of lists (center, i, j, p, q: the meeting; run, side, nodes). What a meeting writes is at most proportional to its classes, see PAIRS."""
    where = ["center", "i", "j", "p", "q"]
    sketches = nodes.join(to, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "n", "bits")
    classes_of = stored(dealt.select(*where, F.explode("nodes").alias("node")).distinct(), "meetings")
    meet = classes_of.join(sketches, "node")
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt_out(lists: DataFrame, meet: DataFrame, own: dict[str, str]) -> DataFrame:
        """Rows of lists and of classes with their own columns, a meeting's in a row."""
        empty = [F.lit(None).cast(t).alias(c) for c, t in own.items()]
        rows = lists.select(*where, "run", "side", "nodes", *empty)
        rows = rows.unionByName(meet.select(*where, F.lit(None).cast("long").alias("run"), F.lit(None).cast("int").alias("side"), F.array("node").alias("nodes"), *own))
        return rows.repartition(parts, *where).sortWithinPartitions(*where)

    def meetings(batches: Iterator[pa.RecordBatch], sets: Sets | None = None) -> Iterator[tuple[tuple, Meeting]]:
        now, group = None, ([], [])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != now:
                    if now:
                        yield now, Meeting(*group, threshold)
                    now, group = row[:5], ([], [])
                    if sets:
                        sets.clear()
                if sets and row[5] is None:
                    sets.add(row[7][0], row[11])
                group[row[5] is not None].append(row[:11])
        if now:
            yield now, Meeting(*group, threshold)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, meeting in meetings(batches):
            a, b = meeting.pairs(PAIRS * len(meeting.node))
            many = a is None
            k = 1 if many else len(a)
            ends = [pa.nulls(1, pa.int64())] * 2 if many else [pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x] * k, t) for x, t in zip(place, types, strict=True)), *ends], names=[*where, "a", "b"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            sets = Sets(file)
            for _, meeting in meetings(batches, sets):
                a, b = meeting.links(sets)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    own = {"component": "long", "n": "int", "bits": "binary"}
    found = stored(dealt_out(dealt, meet, own).mapInArrow(cross, "center long, i int, j int, p int, q int, a long, b long"), "met")
    links = verified(found.filter("a is not null").select("a", "b").distinct(), nodes, docs, threshold, classes)
    crowded = found.filter("a is null").select(*where)
    if crowded.isEmpty():
        return links
    here = sized(crowded, 40)
    lists = stored(dealt.join(here, where, "left_semi"), "lists")
    crowd = classes_of.join(here, where, "left_semi")
    sets = sets_of(crowd.select("node").distinct(), nodes, docs, classes)
    meet = crowd.join(sketches, "node").join(sets, "node")
    settled = dealt_out(lists, meet, own | {"found": "binary"}).mapInArrow(settle, "a long, b long").distinct()
    return links.unionByName(stored(settled, "links"))


class Sets:
    """The sets of a meeting's classes in a file of the worker's, as those of long texts are large; true, however few."""

    def __init__(self, file: BinaryIO):
        self.file, self.at = file, {}

    def __bool__(self) -> bool:
        return True

    def clear(self) -> None:
        self.at.clear()
        self.file.seek(0)
        self.file.truncate()

    def add(self, node: int, found: bytes) -> None:
        self.at[node] = self.file.tell(), len(found)
        self.file.write(found)

    def __getitem__(self, node: int) -> np.ndarray:
        at, size = self.at[node]
        self.file.seek(at)
        return np.frombuffer(self.file.read(size), np.uint64)


class Meeting:
    """Classes (rows of met() with sketches) and the lists, of one center, in which they come together.

    There are at most a few BLOCKs of classes, so a table of all pairs marks who meets whom: within a list that has one
    side, between the sides of one that has two.
    """

    def __init__(self, classes: list[tuple], lists: list[tuple], threshold: Fraction):
        self.t = threshold
        rows = sorted((row[7][0], *row[8:]) for row in classes)
        self.node, self.component, self.n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.bits = [np.frombuffer(r[3], np.uint8) for r in rows]
        self.length = np.array([len(x) for x in self.bits], np.int64)
        self.same: dict[int, np.ndarray] = {}
        self.folded: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(rows), np.int64)
        for size in set(self.length.tolist()):
            at = np.flatnonzero(self.length == size)
            self.place[at] = np.arange(len(at))
            self.same[size] = np.stack([self.bits[k] for k in at])
            self.folded[size] = self.same[size][:, : size // 2] ^ self.same[size][:, size // 2 :]
        sides: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        within = False
        for _, i, j, p, q, run, side, members, *_ in lists:
            within = i == j and p == q
            sides[run][side] = np.searchsorted(self.node, np.array(members, np.int64))
        self.lists = [(s[0], s[0]) if within else (s[0], s[1]) for s in sides.values() if within or len(s) == 2]

    def _meet(self) -> np.ndarray:
        """Who meets whom."""
        meet = np.zeros((len(self.node), len(self.node)), bool)
        for one, two in self.lists:
            meet[np.ix_(one, two)] = True
        return meet | meet.T

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
        """The pairs a < b that the screen passes; none if there are more than most."""
        meet, found, n = self._meet(), [np.zeros((2, 0), np.int64)], 0
        for k in range(len(self.node)):
            others, _ = self._from(k, k + 1 + np.flatnonzero(meet[k, k + 1 :]))
            n += len(others)
            if n > most:
                return None, None
            found.append(np.stack([np.full(len(others), self.node[k]), self.node[others]]))
        a, b = np.sort(np.concatenate(found, axis=1), axis=0)
        return a, b

    def links(self, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        """Links (a < b) that join what all links of the meeting and the components would; of each class the nearest pairs first."""
        meet, joined = self._meet(), np.unique(self.component, return_inverse=True)[1]
        out: list[tuple[int, int]] = []
        for k in range(len(self.node)):
            others, far = self._from(k, k + 1 + np.flatnonzero(meet[k, k + 1 :]))
            others = others[np.argsort(far / (self.n[k] + self.n[others]), kind="stable")]
            mine = sets[int(self.node[k])] if len(others) else None
            while len(others := others[joined[others] != joined[k]]):
                at = next((i for i, x in enumerate(self.node[others].tolist()) if linked(mine, sets[x], self.t)), None)
                if at is None:
                    break
                out.append((k, int(others[at])))
                joined[joined == joined[others[at]]] = joined[k]
                others = others[at + 1 :]
        a, b = np.sort(self.node[np.array(out, np.int64).reshape(-1, 2).T], axis=0)
        return a, b

    def _from(self, k: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the others, of other components, that the screen leaves room for a link with, and their distances."""
        p, q = self.t.numerator, self.t.denominator
        n, m = self.n[k], self.n[others]
        others = others[(self.component[others] != self.component[k]) & (np.minimum(n, m) * q >= np.maximum(n, m) * p)]
        kept = [np.zeros((2, 0), np.int64)]
        size, mine = int(self.length[k]), self.bits[k]
        for other in set(self.length[others].tolist()):
            at = others[self.length[others] == other]
            theirs, own = self.same[other][self.place[at]] if other <= size else self.folded[other][self.place[at]], mine
            if other < size:
                own = self.folded[size][self.place[k]]
            if len(own) != theirs.shape[1]:  # sketches more than twice as long: sizes within 3/4 never have them
                far = np.array([distance(self.bits[x].tobytes(), mine.tobytes()) for x in at])
            else:
                far = np.bitwise_count(theirs ^ own).sum(1).astype(np.int64)
            room = far * (p + q) <= (q - p) * (n + self.n[at])
            kept.append(np.stack([at[room], far[room]]))
        found, far = np.concatenate(kept, axis=1)
        return found, far


def near_groups(docs: DataFrame, threshold: Fraction = THRESHOLD, bucket_keys: int = BUCKET_KEYS, mask: int = -1) -> DataFrame:
    """A row for each document (doc_id, text): doc_id, text_hash (xxhash64 of the text), n_shingles, links_compared, component_id.

    component_id is the smallest doc_id that links lead to, itself included. links_compared counts the links of a set
    that were looked at: two sets that others have already joined are not compared. Null and empty texts have no
    shingles, link with nothing and are their own component. Null doc_ids count as larger than all others. Repeated rows
    give repeated rows in one component; a long text takes some 60 bytes a character while it is worked on; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs, seed, classes = docs.select("doc_id", "text"), 0, Classes(mask=mask)
    while True:
        seen = stored(summaries(docs, threshold, seed, classes), "summaries")
        rows = seen.filter("node is not null")
        if rows.filter("short > 0").isEmpty():
            break
        seed += 1  # a sketch has fewer words than the pigeonhole needs: other places for the tokens
    numbers = rows.filter("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    shared = [r["node"] for r in numbers.filter("low <> high").select("node").collect()]  # two sets with one number: one in 2^64 pairs
    if shared:
        classes = Classes(frozenset(shared), mask)
        own = F.pandas_udf(lambda node, check: pd.Series([classes.own(a, b) if a in classes.shared else a for a, b in zip(node.tolist(), check.tolist(), strict=True)], dtype="int64"), "long")
        rows = stored(rows.withColumn("node", own("node", "check")), "summaries")
    words = seen.filter("word is not null").groupBy("word").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON_MOST).toArrow()
    common = words.column("word").to_numpy().astype(np.int64).view(np.uint64)
    counts = words.column("n").to_numpy()
    heavy = {int(w): int(-(-n // bucket_keys)) for w, n in zip(common[counts > bucket_keys], counts[counts > bucket_keys], strict=True)}
    common = np.sort(common)
    nodes = stored(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    copies = rows.filter("n > 0").select("doc_id").distinct().join(nodes.select("doc_id"), "doc_id", "left_anti")
    firsts = docs.join(sized(copies, 16), "doc_id", "left_anti")

    total = nodes.agg(F.coalesce(F.sum(F.col("n") * float(1 / threshold - 1) * 1.2 + 1), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / BUCKET_KEYS) + 1)
    found = stored(whole_runs(stored(runs(key_blocks(firsts, common, heavy, buckets, threshold, seed, classes), buckets), "parts")), "runs")
    stars = found.select(F.col("center").alias("a"), F.explode("nodes").alias("b")).filter("a <> b").distinct()
    links = verified(screened(stars, nodes, threshold), nodes, docs, threshold, classes)
    groups = components(links)
    more, wide = within(found, groups, nodes, docs, threshold, classes)
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = components(links)
    if not wide.isEmpty() and not (more := across(wide, groups, nodes, docs, threshold, classes)).isEmpty():
        links = links.unionByName(more)
        groups = components(links)

    grouped = stored(nodes.select("node", F.col("doc_id").alias("least")).join(groups, "node"), "grouped")
    lowest = stored(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    found = grouped.join(sized(lowest, 24), "component").select("node", "component_id")
    known = nodes.select("node", F.col("doc_id").alias("least")).join(found, "node", "left").select("node", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    out = rows.select("doc_id", "text_hash", "node", "n").join(known.join(degrees, "node", "left"), "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("links_compared"), own.alias("component_id"))
