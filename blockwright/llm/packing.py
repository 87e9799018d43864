"""Best-fit packing of documents into token sequences, by residual merging over a tree of partitions.

Each partition of the input tokenises its documents and packs them best-fit decreasing; sequences that are nearly full
leave for good. The others are items, whole, of a further best-fit round over fewer partitions, until one is left.

Two sequences can only meet if one is at most half full, and best fit leaves at most one such in a task. So most
underfull ones have no partner anywhere. Before each round the sizes of all of them are counted (a row a size) and
packed best-fit as numbers, which tells how many of each size take part; as many go on, and the others, for which there
is no use, stay as they are. A round thus moves at most two sequences for each task before it; documents never move.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, sized, stored, whole_text

CAPACITY = 1024
#: The id that ends each document.
END = 2
#: A sequence with as many tokens is nearly full and stays as it is.
NEARLY = 1008
#: Partitions that meet in one task of the next round.
FAN_IN = 8

_encoders: dict[tuple, Callable[[str], list[int]]] = {}
#: Outside these characters (and where a special token may be written out) the two libraries could split texts differently.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞€]|<\\|")


def encoder(path: str, ranks: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids by the tokenizers file at path; by its vocabulary as ranks, which is faster, where both surely agree."""
    if (path, ranks) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        encode = lambda text: slow.encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
            by_file = encode
            encode = lambda text: by_file(text) if UNUSUAL.search(text) else quick(text)
        _encoders[path, ranks] = encode
    return _encoders[path, ranks]


def pieces(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids): whole if it fits, else cut so that only the first piece may be shorter."""
    if len(ids) <= capacity:
        cuts = [0, len(ids)]
    else:
        cuts = sorted({0, *range(len(ids) % capacity, len(ids) + 1, capacity)})
    raw = np.array(ids, "<u4")
    return [(k, a, b - a, zlib.crc32(raw[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices by bin, largest sizes first, each into the fullest bin that takes it. Ties go by index and by the bin opened last."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin has room for r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            k, room = len(bins), capacity
            bins.append([])
        bins[k].append(i)
        if left := room - size:
            by_room[left].append(k)
            rooms |= 1 << left
    return bins


def useful(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, int]:
    """Of sequences by size, how many of each size a best-fit packing of them all puts together with others.

    Only those at most half full are walked one by one; best fit leaves one of them in a task at most.
    """
    alone = {u: n for u, n in counts.items() if 2 * u > capacity}
    met: list[list[int]] = []  # the sizes that come together
    by_room: dict[int, list[list[int]]] = defaultdict(list)
    rooms = sum(1 << capacity - u for u in alone)  # bit r: there is room for r
    for size in (u for u in sorted(counts, reverse=True) if 2 * u <= capacity for _ in range(counts[u])):
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            if by_room[room]:
                sizes = by_room[room].pop()
            else:
                alone[capacity - room] -= 1
                met.append(sizes := [capacity - room])
            if not by_room[room] and not alone.get(capacity - room):
                rooms &= ~(1 << room)
        else:
            room = capacity
            met.append(sizes := [])
        sizes.append(size)
        if left := room - size:
            by_room[left].append(sizes)
            rooms |= 1 << left
    return dict(Counter(u for sizes in met if len(sizes) > 1 for u in sizes))


MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
SEQUENCE = "sequence_id long, task int, used int, place int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _batches(bins: list[list[tuple]], level: int) -> Iterator[pa.RecordBatch]:
    """Sequences of member tuples (doc_id, piece, start, length, crc) as rows; place numbers those of one size in the task."""
    task = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for at in range(0, len(bins), 5000):
        part = bins[at : at + 5000]
        flat = [m for b in part for m in b]
        ends = np.cumsum([0, *map(len, part)])
        lengths = np.array([m[3] for m in flat], np.int64)
        before = np.cumsum(lengths) - lengths
        offsets = before - np.repeat(before[ends[:-1]], np.diff(ends))
        columns = [*zip(*flat, strict=True), offsets]
        members = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MEMBER, strict=True)], fields=list(MEMBER))
        used = np.add.reduceat(lengths, ends[:-1]).astype(np.int32)
        places = []
        for u in used.tolist():
            places.append(seen.get(u, 0))
            seen[u] = places[-1] + 1
        ids = (level << 58) + (task << 31) + np.arange(at, at + len(part), dtype=np.int64)
        arrays = [pa.array(ids), pa.array(np.full(len(part), task, np.int32)), pa.array(used), pa.array(places, pa.int32()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), members)]
        yield pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "task", "used", "place", "members"])


def quotas(sequences: DataFrame, capacity: int) -> DataFrame | None:
    """How many sequences of each size each task hands on (task, used, quota); None if there is no use for any."""
    counted = sequences.filter(F.col("used") < min(NEARLY, capacity - 1)).groupBy("task", "used").agg(F.count("*").alias("n"))
    counted = stored(counted, "sizes")
    sizes = {r["used"]: r["n"] for r in counted.groupBy("used").agg(F.sum("n").alias("n")).collect()}  # a row a size
    wanted = useful(sizes, capacity)
    if not wanted:
        return None
    need = F.element_at(F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)), F.col("used"))
    turn = Window.partitionBy("used").orderBy(F.xxhash64("task"), "task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    known = counted.filter(F.col("used").isin(*wanted)).withColumn("before", F.coalesce(F.sum("n").over(turn), F.lit(0)))
    return known.select("task", "used", F.least(F.col("n"), need - F.col("before")).alias("quota")).filter("quota > 0")


def pack(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of at most capacity tokens over all documents (doc_id, text): sequence_id, used, members in their order.

    A null text counts as empty, and an empty one is the end id alone; a long one is cut into pieces. Null and repeated
    doc_ids are packed as any other, row by row; an empty table gives no sequence; other columns are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, items, full = encoder(path, ranks), [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in pieces([*encode(text), END], capacity):
                    (full if p[2] == capacity else items).append((doc_id, *p))
        yield from _batches([[p] for p in full] + [[items[i] for i in b] for b in best_fit([p[3] for p in items], capacity)], 0)

    source = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    now, done = stored(source.mapInArrow(first, SEQUENCE), "packed"), []
    tasks = now.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1
    while tasks > 1 and (quota := quotas(now, capacity)) is not None:
        level, tasks = len(done) + 1, -(-tasks // FAN_IN)

        def merge(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            bins, used = [], []
            for batch in batches:
                for members, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    bins.append([(m["doc_id"], m["piece"], m["start"], m["length"], m["ids_crc32"]) for m in members])
                    used.append(n)
            yield from _batches([[m for i in b for m in bins[i]] for b in best_fit(used, capacity)], level)

        shared = now.join(sized(stored(quota, "quota"), 16), ["task", "used"], "left")
        done.append(shared.filter("quota is null or place >= quota"))
        met = shared.filter("place < quota").withColumn("to", F.pmod(F.col("task"), F.lit(tasks))).repartition(tasks, "to").sortWithinPartitions(F.desc("used"), "sequence_id")
        now = stored(met.select("members", "used").mapInArrow(merge, SEQUENCE), "packed")
    columns = ["sequence_id", "used", "members"]
    return reduce(DataFrame.unionByName, (r.select(*columns) for r in [*done, now]))


def placed(sequences: DataFrame) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return sequences.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
