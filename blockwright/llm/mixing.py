"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up by cell (source, language, topic). Raking scales the cells' weights until each marginal has
its target share. A document's probability is its cell's weight over the cell's tokens, scaled to the token budget and
at most 1; it is drawn if a hash of its id falls below. Only cells are gathered, never documents; more cells than
CELLS are raked by DataFrame operations, step by step with the same arithmetic.

Documents without a topic column get one: the nearest of TOPICS centers in a latent space of their words. Both are found
over all documents: each step adds up matrices of a fixed size, by task and then by slice, and only sums are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, sized, stored, whole_text
from .ngram_join import word_hashes

DIMENSIONS = ("source", "lang", "topic")
#: Targets are the shares to this power, made to add up to 1: small sources gain.
SMOOTHING = 0.7
#: Of all tokens, the share that the sample should have.
BUDGET = 0.6
#: Cells that are raked on the driver: 200,000 rows of about 100 bytes.
CELLS = 200_000
ROUNDS, TOLERANCE = 200, 1e-10
SEED = 20
#: Topics, hashed words and dimensions of their space.
TOPICS, COLUMNS, AXES = 12, 2048, 24
#: Steps towards the space's directions and, at most, towards the centers; each reads what is known of all documents.
SPACE_ROUNDS, CENTER_ROUNDS = 4, 12
#: Slices of a matrix that is added up.
SLICES = 16


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def word_shares(text: bytes) -> np.ndarray:
    """The square roots of the counts of a text's words, hashed to COLUMNS."""
    return np.sqrt(np.bincount((word_hashes(text) >> np.uint64(53)).astype(np.int64), minlength=COLUMNS)).astype(np.float32)


@dataclass
class Topics:
    """Directions (COLUMNS by topics) in which the centers lie; a text's topic is the one along which it reaches farthest."""

    directions: np.ndarray

    def of(self, texts: list[bytes]) -> list[str]:
        """A name for each text: "none" for one without words (or without centers)."""
        if not self.directions.shape[1] or not texts:
            return ["none"] * len(texts)
        found = np.stack([word_shares(t) for t in texts])
        nearest = (found @ self.directions).argmax(1)
        return [f"topic {k:02d}" if some else "none" for k, some in zip(nearest.tolist(), found.any(1).tolist(), strict=True)]


def _packed(found: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of word_shares() without their zeros, as one row: sizes, at and shares."""
    x = np.stack(found)
    row, at = np.nonzero(x)
    parts = (np.bincount(row, minlength=len(x)).astype(np.int32), at.astype(np.uint16), x[row, at].astype(np.float16))
    return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["sizes", "at", "shares"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for sizes, at, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(sizes, np.int32)
            x = np.zeros((len(n), COLUMNS), np.float32)
            x[np.repeat(np.arange(len(n)), n), np.frombuffer(at, np.uint16)] = np.frombuffer(shares, np.float16)
            yield x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of what part makes of each task's batches: matrices of a shape, dealt by slices of their rows and added up there, in the order of the tasks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.array_split(np.asarray(part(batches), np.float64).reshape(shape), SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())], names=["slice", "task", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, one in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                now[at] = now.get(at, 0.0) + np.frombuffer(one, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int32()), pa.array([m.tobytes() for m in now.values()], pa.binary())], names=["slice", "part"])

    dealt = rows.mapInArrow(parts, "slice int, task int, part binary").repartition(SLICES, "slice").sortWithinPartitions("slice", "task")
    got = dict(dealt.mapInArrow(add, "slice int, part binary").toPandas().itertuples(index=False, name=None))
    return np.concatenate([np.frombuffer(got[k], np.float64) for k in range(SLICES) if k in got] or [np.zeros(shape[0] * shape[1])]).reshape(shape)


def fit_topics(docs: DataFrame, topics: int = TOPICS) -> Topics:
    """Topics of all documents: word counts by inverse document frequency, their principal directions, k-means there.

    Directions are found by subspace iteration from fixed random ones, each round over all documents; the first one is
    left out: it is what all texts share. Centers begin at both ends of the first axes left. Words without their zeros
    and places in the space are written to the shared folder; sums of 2048 by 41 numbers at most come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _packed([word_shares(t) for t in batch.column(0).to_pylist()])

    arrow_batches(docs.sparkSession)
    texts = docs.filter(whole_text().rlike(r"[^\x20\x09-\x0D]")).select(whole_text().cast("binary").alias("text"))
    words = stored(texts.mapInArrow(count, "sizes binary, at binary, shares binary"), "words")

    def occur(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(COLUMNS + 1)
        for x in _unpacked(batches):
            total += np.append((x > 0).sum(0), len(x))
        return total

    *occurs, n = summed(words, occur, (COLUMNS + 1, 1)).ravel()
    if not n:
        return Topics(np.zeros((COLUMNS, 0), np.float32))
    idf = np.log((1 + n) / (1 + np.array(occurs))) + 1
    wide = int(min(AXES + 17, n))
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(COLUMNS, wide)))[0]
    for _ in range(SPACE_ROUNDS):
        start = q

        def reach(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> np.ndarray:
            total = np.zeros((COLUMNS, wide))
            for x in _unpacked(batches):
                y = _unit(x * idf)
                total += y.T @ (y @ start)
            return total

        y = summed(words, reach, (COLUMNS, wide))
        q = np.linalg.qr(y)[0]
    inner = start.T @ y  # how far texts reach along the last start, squared
    space = (start @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1])[:, 1 : AXES + 1]
    space = space * np.where(space[np.abs(space).argmax(0), np.arange(space.shape[1])] < 0, -1, 1)
    axes = space.shape[1]
    if not axes:
        return Topics(np.zeros((COLUMNS, 1), np.float32))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_unit(_unit(x * idf) @ space).astype(np.float32).tobytes()], pa.binary())], names=["points"])

    points = stored(words.mapInArrow(place, "points binary"), "points")
    now = np.concatenate([np.eye(axes), -np.eye(axes)], axis=1).reshape(-1, axes)[:topics]
    for _ in range(CENTER_ROUNDS):
        centers = now

        def gather(batches: Iterator[pa.RecordBatch], centers: np.ndarray = centers) -> np.ndarray:
            total = np.zeros((len(centers), axes))
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    x = np.frombuffer(block, np.float32).reshape(-1, axes).astype(np.float64)
                    np.add.at(total, (x @ centers.T).argmax(1), x)
            return total

        sums = summed(points, gather, now.shape)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        now = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-30), now)
        if np.abs(now - centers).max() < 1e-6:
            break
    return Topics((idf[:, None] * (space @ now.T)).astype(np.float32))


def topic_of(docs: DataFrame, topics: Topics) -> Column:
    """The topic of each row's text."""
    sent = docs.sparkSession.sparkContext.broadcast(topics)  # COLUMNS by topics numbers
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.of(texts.tolist()), dtype=object)

    return find(whole_text().cast("binary"))


def described(docs: DataFrame, topic: Column | None = None, whole: bool = True) -> DataFrame:
    """d (the row itself, if whole), id, source, lang, topic and tokens; a null source, lang or topic counts as an empty one. Without a topic, topics are fitted."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")] if whole else []
    made = topic_of(docs, fit_topics(docs)) if topic is None else topic
    parts = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(DIMENSIONS, (F.col("source"), F.col("lang"), made), strict=True)]
    return docs.select(*row, F.col("doc_id").cast("long").alias("id"), *parts, token_count(whole_text()).alias("tokens"))


def rake(tokens: np.ndarray, keys: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights that add up to 1, whose sums by each marginal (keys: its value's number in each cell) are the targets."""
    w = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for key, target in zip(keys, targets, strict=True):
            now = np.bincount(key, w, len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            worst = max(worst, float(np.abs(now - target).max(initial=0)))
            w = w * factor[key]
        if worst < tolerance:
            break
    return w


def scale(tokens: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """The factor by which expected tokens, with probabilities at most 1, are the budget's share of all.

    Cells that a factor would draw more than once are drawn once, and the others get what is left; each step finds more
    of them, so a few steps end it.
    """
    goal, s = budget * float(tokens.sum()), 0.0
    while True:
        full = (weights * s >= tokens) & (weights > 0)
        rest = float(weights[~full].sum())
        new = (goal - float(tokens[full].sum())) / rest if rest > 0 else s
        if new <= s:
            return s
        s = new


def default_targets(cells: DataFrame, smoothing: float = SMOOTHING) -> dict[str, DataFrame]:
    """For each dimension: value and share."""
    out = {}
    for name in DIMENSIONS:
        sums = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0").select("value", F.pow(F.col("t").cast("double"), F.lit(smoothing)).alias("s"))
        total = sums.agg(F.sum("s")).first()[0] or 1.0
        out[name] = sums.select("value", (F.col("s") / F.lit(total)).alias("share"))
    return out


def _there(cells: DataFrame, targets: dict[str, DataFrame], name: str) -> DataFrame:
    """value and share of those targets of a dimension that some cell has."""
    return targets[name].join(cells.select(F.col(name).alias("value")).distinct(), "value", "left_semi").groupBy("value").agg(F.sum("share").alias("share"))


def _on_driver(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    got = cells.orderBy(*DIMENSIONS).toPandas()
    tokens, keys, shares = got["tokens"].to_numpy(np.float64), [], []
    for name in DIMENSIONS:
        values, key = np.unique(got[name].to_numpy(str), return_inverse=True)
        by = {r["value"]: r["share"] for r in _there(cells, targets, name).collect()}  # no more rows than cells
        share = np.array([by.get(v, 0.0) for v in values])
        keys.append(key)
        shares.append(share / max(share.sum(), 1e-300))
    w = rake(tokens, keys, shares)
    got["weight"] = w
    got["probability"] = np.minimum(1, scale(tokens, w, budget) * np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0))
    spark = cells.sparkSession
    return spark.createDataFrame(list(got[[*DIMENSIONS, "weight", "probability"]].itertuples(index=False, name=None)), "source string, lang string, topic string, weight double, probability double")


def _on_cluster(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1))))
    there = {n: stored(_there(cells, targets, n), "targets") for n in DIMENSIONS}
    sums = {n: t.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0] for n, t in there.items()}
    for _ in range(rounds):
        worst = 0.0
        for n in DIMENSIONS:
            now = w.groupBy(n).agg(F.sum("weight").alias("now")).join(there[n].select(F.col("value").alias(n), (F.col("share") / F.lit(sums[n] or 1.0)).alias("share")), n, "left").fillna(0.0, ["share"])
            now = stored(now, "marginals")
            worst = max(worst, now.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0)
            factor = F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0)
            w = w.join(now, n).withColumn("weight", F.col("weight") * factor).drop("now", "share")
        w = stored(w.select(*DIMENSIONS, "tokens", "weight"), "cells")
        if worst < tolerance:
            break
    goal, s = budget * float(total), 0.0
    while True:
        full = (F.col("weight") * F.lit(s) >= F.col("tokens")) & (F.col("weight") > 0)
        row = w.agg(F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0))).first()
        new = (goal - float(row[1])) / row[0] if row[0] > 0 else s
        if new <= s:
            break
        s = new
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    return w.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.lit(s) * ratio).alias("probability"))


def calibrated(rows: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, cells_on_driver: int = CELLS) -> DataFrame:
    """source, lang, topic, weight and probability of each cell of described rows."""
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or default_targets(cells)
    return (_on_driver if cells.count() <= cells_on_driver else _on_cluster)(cells, targets, budget)


def uniform(id_: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 by a hash of an id; null ids share one."""
    return F.xxhash64(F.lit(seed), id_).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def drawn(rows: DataFrame, cells: DataFrame, seed: int = SEED) -> DataFrame:
    """Described rows with their cell's weight and probability, and whether they are selected."""
    size = cells.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in DIMENSIONS), F.lit(100))), F.lit(0))).first()[0]
    return rows.join(sized(cells, 1, size), list(DIMENSIONS)).withColumn("selected", uniform(F.col("id"), seed) < F.col("probability"))


def assign(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = SEED, topic: Column | None = None, cells_on_driver: int = CELLS) -> DataFrame:
    """As mix(), without the rows themselves: texts are read once more after the topics are fitted, and what is known of them is written to the shared folder."""
    rows = stored(described(docs, topic, whole=False), "described")
    return drawn(rows, calibrated(rows, targets, budget, cells_on_driver), seed)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = SEED, topic: Column | None = None, cells_on_driver: int = CELLS) -> DataFrame:
    """The described rows of documents (doc_id, text, source, lang) with weight, probability and selected.

    Targets give shares by value for source, lang and topic; values without documents are left out and the others scaled
    up; values without a share are never drawn. A null text counts as empty; documents without tokens are in their cell
    and drawn with its probability (a cell without any tokens has 0). A cell is drawn once at most, so with a large
    budget cells of small ones fall short of their target and the others get what is left. Equal ids, null ones too, are
    drawn together; rows keep all their columns, whatever their names; a long text is one row's work; an empty table
    gives no rows.
    """
    made = topic_of(docs, fit_topics(docs)) if topic is None else topic
    return drawn(described(docs, made), calibrated(described(docs, made, whole=False), targets, budget, cells_on_driver), seed)
