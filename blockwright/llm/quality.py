"""Text quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte trigrams and, for each word, its shape and whether it repeats the word before it (capitals
aside), all hashed to a fixed number of columns. Shapes and repeats are there for junk: symbols behind words, stuttering. A singular value decomposition of the weighted term counts of a bounded sample of
labelled texts gives the space. The sample's vectors are broadcast (their number is a parameter, so is their size);
every document's exact cosine to all of them is a blocked matrix product, and its nearest neighbours vote with weights
that rise with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, whole_text
from .ngram_join import word_hashes

#: Labelled rows that the space is fitted on, at most half of them of either label, and dimensions of the space.
SAMPLE, DIMENSIONS = 3000, 48
NEIGHBOURS = 25
#: The weight of a neighbour is its cosine to this power.
SHARPNESS = 8
#: From this score a text counts as good.
GOOD = 0.3
TRIGRAMS, SHAPES = 1024, 256
COLUMNS = TRIGRAMS + 2 * SHAPES + 16
#: Documents of one matrix product.
BLOCK = 256

#: Bytes by class: white space 0, capitals 1, small letters (and all beyond ASCII) 2, digits 3, others themselves.
_CLASS = np.array([0 if c in b" \t\n\x0b\x0c\r" else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 3 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
#: Runs of one class that make a word's shape.
RUNS = 8
_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 62, RUNS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shapes(b: np.ndarray) -> np.ndarray:
    """The shape of each word of a text's bytes, below SHAPES: its first runs of one class, hashed."""
    kind = _CLASS[b]
    at = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)) if len(kind) else kind)  # where a run begins (a leading space has none)
    at = at if len(kind) and kind[0] == 0 else np.union1d(at, [0])
    run = kind[at]
    first = (run != 0) & (np.concatenate([[0], run[:-1]]) == 0)
    word = np.flatnonzero(first)
    inside = np.flatnonzero(run != 0)
    place = inside - np.repeat(word, np.diff(np.append(np.searchsorted(inside, word), len(inside))))
    value = np.where(place < RUNS, run[inside].astype(np.uint64) * _WEIGHTS[np.minimum(place, RUNS - 1)], np.uint64(0))
    total = np.add.reduceat(value, np.searchsorted(inside, word)) * np.uint64(0x9E3779B97F4A7C15)
    return (total >> np.uint64(56)).astype(np.int64)


def terms(text: bytes) -> np.ndarray:
    """The weighted counts of a text's terms; three blocks of length one each, or zero in an empty text."""
    out = np.zeros(COLUMNS, np.float32)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:]) * np.uint32(0xC2B2AE35)
        out[:TRIGRAMS] = np.sqrt(np.bincount(h >> np.uint32(22), minlength=TRIGRAMS))
    h = word_hashes(text)
    if len(h):
        shape = shapes(np.frombuffer(text, np.uint8))
        same = h[1:] == h[:-1]
        out[TRIGRAMS : TRIGRAMS + SHAPES] = np.sqrt(np.bincount(shape, minlength=SHAPES))
        out[TRIGRAMS + SHAPES : TRIGRAMS + 2 * SHAPES] = np.sqrt(np.bincount(shape[1:][same], minlength=SHAPES))
        tail = out[-16:]
        tail[int(7.999 * len(np.unique(h)) / len(h))] = 1
        tail[8 + int(7.999 * same.sum() / len(h))] = 1
    for a, b_ in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + 2 * SHAPES), (COLUMNS - 16, COLUMNS)):
        if norm := np.linalg.norm(out[a:b_]):
            out[a:b_] /= norm
    return out


@dataclass
class Model:
    """The space (columns by dimensions, inverse document frequencies included), the sample's vectors and labels."""

    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        """Of rows of terms; a text without terms, or without a neighbour of positive cosine, has score 0."""
        if not len(self.labels):
            return np.zeros(len(found))
        v = unit(found @ self.space)
        out = np.zeros(len(v))
        for at in range(0, len(v), BLOCK):
            cosines = np.maximum(v[at : at + BLOCK] @ self.vectors.T, np.float32(0))
            n = cosines.shape[1]
            k, shift = min(NEIGHBOURS, n), n.bit_length()
            order = (np.ascontiguousarray(cosines, np.float32).view(np.int32).astype(np.int64) << shift) - np.arange(n)  # no two alike: of equal cosines the first
            near = np.argpartition(-order, k - 1, axis=1)[:, :k]
            weights = np.take_along_axis(cosines, near, 1).astype(np.float64) ** SHARPNESS
            total = weights.sum(1)
            out[at : at + BLOCK] = np.divide((weights * self.labels[near]).sum(1), total, out=np.zeros(len(total)), where=total > 0)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id and label (0 or 1) of at most sample rows that aren't held out: half of each label, by a hash of doc_id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    order = (F.xxhash64("doc_id"), "doc_id")
    return known.filter("label = 0").orderBy(*order).limit(sample // 2).unionByName(known.filter("label = 1").orderBy(*order).limit(sample // 2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """The model of a bounded sample of labelled texts, with both labels in equal parts where there are enough of each.

    Only the sample's term counts come to the driver: at most sample rows of COLUMNS half-precision numbers (9 MB by
    default). Of rows that repeat a doc_id one is taken, by its terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "terms"])

    chosen = F.broadcast(sampled(labels, label, sample))  # at most sample rows
    texts = docs.select("doc_id", whole_text().cast("binary").alias("text")).join(chosen, "doc_id").select(F.col("doc_id").cast("long"), "label", "text")
    found = texts.mapInArrow(run, "doc_id long, label int, terms binary").groupBy("doc_id", "label").agg(F.min("terms").alias("terms"))
    got = found.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    y = got.column("label").to_numpy().astype(np.float64)
    if not len(y):
        return Model(np.zeros((COLUMNS, dimensions), np.float32), np.zeros((0, dimensions), np.float32), y)
    x = np.stack([np.frombuffer(t, np.float16) for t in got.column("terms").to_pylist()]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    weighted = x * idf
    values, axes = np.linalg.eigh(weighted.T @ weighted)
    space = (idf[:, None] * axes[:, np.argsort(-values)[:dimensions]]).astype(np.float32)
    return Model(space, unit(x @ space), y)


def scored(docs: DataFrame, model: Model) -> Column:
    """The score of each row's text, as a column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [sent.value.scores(np.stack([terms(t) for t in texts.iloc[at : at + BLOCK]])) for at in range(0, len(texts), BLOCK)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    arrow_batches(docs.sparkSession)
    return score(whole_text().cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """A row for each document (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= GOOD).

    Rows whose crc32 of doc_id is divisible by 5 are held out of the sample; so are labels that are null or not 0 or 1.
    Null texts count as empty; an empty text has score 0, and without any labelled row all have. Of neighbours that are
    equally near, those with the smaller doc_id vote. A null doc_id isn't held out. Repeated rows give repeated rows; a
    long text is one row's work; an empty table gives none; of documents only doc_id and text are read.
    """
    score = scored(docs, fit(docs, labels, label, sample))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))
