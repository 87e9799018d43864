"""Quality, mixing, personal data, packing and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blockwright.llm import mixing, packing, quality, queries

from . import cases


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_quality(spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(r.predicted, y) for r, y in labels if r.held_out]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_quality_of_odd_rows(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(r.doc_id, i % 2) for i, r in enumerate(docs.filter("doc_id < 300").collect())] + [(None, 1), (4, None), (7, 5)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(cases.empty(spark), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.0}


def test_blocked_cosines_are_exact():
    rng = np.random.default_rng(2)
    vectors = quality.unit(rng.normal(size=(300, 8)).astype(np.float32))
    model = quality.Model(np.eye(8, dtype=np.float32), vectors, (rng.random(300) < 0.5).astype(float))
    x = rng.normal(size=(600, 8)).astype(np.float32)
    for row, score in zip(x, model.scores(x)):
        cos = vectors @ (row / np.linalg.norm(row))
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0).astype(float) ** quality.SHARPNESS
        assert score == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-4)


def test_of_equally_near_neighbours_the_first_vote():
    rng = np.random.default_rng(4)
    vectors = quality.unit(np.repeat(rng.normal(size=(30, 8)), 10, 0).astype(np.float32))
    model = quality.Model(np.eye(8, dtype=np.float32), vectors, (rng.random(300) < 0.5).astype(float))
    x = rng.normal(size=(50, 8)).astype(np.float32)
    for row, score in zip(x, model.scores(x)):
        cos = np.maximum(quality.unit(row[None]) @ vectors.T, 0)[0]
        cos = np.round(cos, 6)
        near = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
        w = cos[near].astype(float) ** quality.SHARPNESS
        assert score == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-4)


def test_raking_meets_the_targets_and_both_ways_agree(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 2000)), rng.choice(["en", "de", "fr", None]), rng.choice("abcd"), *[None] * 5) for i in range(400)]
    docs = cases.frame(spark, rows)
    rows = mixing.described(docs, (F.col("doc_id") % 7).cast("string"))
    here = {(r.source, r.lang, r.topic): r for r in mixing.calibrated(rows, budget=0.3).collect()}
    there = {(r.source, r.lang, r.topic): r for r in mixing.calibrated(rows, budget=0.3, cells_on_driver=0).collect()}
    assert here.keys() == there.keys()
    for k in here:
        assert here[k].weight == pytest.approx(there[k].weight, rel=1e-9) and here[k].probability == pytest.approx(there[k].probability, rel=1e-9)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    tokens = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}
    for at, name in enumerate(mixing.DIMENSIONS):
        want = {r["value"]: r.share for r in mixing.default_targets(cells)[name].collect()}
        got = defaultdict(float)
        for k, r in here.items():
            got[k[at]] += r.weight
        assert got == pytest.approx(want, abs=1e-8)
    assert sum(tokens[k] * r.probability for k, r in here.items()) == pytest.approx(0.3 * sum(tokens.values()), rel=1e-6)


def test_the_mix_of_a_whole_table(spark):
    """Topics by the nearest center, plain raking over dictionaries, draws by the ids' hashes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    topics = mixing.fit_topics(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    topic = {}
    for d, r in rows.items():
        x = mixing.word_shares((r.text or "").encode())
        topic[d] = f"topic {max(range(topics.directions.shape[1]), key=lambda k: float(x.astype(np.float64) @ topics.directions[:, k].astype(np.float64))):02d}" if x.any() else "none"
    tokens = {d: len(re.findall("[^ \t-\r]+", r.text or "")) for d, r in rows.items()}
    cell = {d: (r.source or "", r.lang or "", topic[d]) for d, r in rows.items()}
    sums = defaultdict(int)
    for d, c in cell.items():
        sums[c] += tokens[d]
    total, w, targets = sum(sums.values()), {}, []
    for k in range(3):
        by = defaultdict(int)
        for c, n in sums.items():
            by[c[k]] += n
        smooth = {v: n**mixing.SMOOTHING for v, n in by.items() if n}
        targets.append({v: s / sum(smooth.values()) for v, s in smooth.items()})
    w = {c: n / total for c, n in sums.items()}
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[k]] += x
            w = {c: x * targets[k].get(c[k], 0) / now[c[k]] if now[c[k]] else 0 for c, x in w.items()}
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(n, mid * w[c]) for c, n in sums.items()) < mixing.BUDGET * total else (low, mid)
    got = {r.doc_id: r for r in queries.op2_mixing(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == rows.keys()
    for d, r in got.items():
        p = min(1, high * w[cell[d]] / sums[cell[d]]) if sums[cell[d]] else 0
        assert (r.source, r.lang, r.topic, r.tokens) == (*cell[d], tokens[d])
        assert r.weight == pytest.approx(w[cell[d]], rel=1e-6, abs=1e-12) and r.probability == pytest.approx(p, rel=1e-6, abs=1e-12)
        h = xxhash.xxh64(int(mixing.SEED).to_bytes(4, "little"), seed=42).intdigest()
        h = xxhash.xxh64(d.to_bytes(8, "little"), seed=h).intdigest()
        assert r.selected == ((h & (1 << 53) - 1) / (1 << 53) < r.probability)
    assert len({r.topic for r in got.values()}) > 3


def test_mixing_odd_rows(spark):
    docs = cases.frame(spark)
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("topic", F.lit("x")).withColumn("tokens", F.lit(0))
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.probability <= 1 for r in got)
    drawn = defaultdict(set)
    for r in got:
        drawn[r.id, r.source, r.lang, r.topic].add(r.selected)
        assert r.tokens == len(re.findall("[^ \t-\r]+", r.d.text or ""))
    assert all(len(v) == 1 for v in drawn.values())
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    path, ranks = queries.tokenizer_files()
    rows = cases.documents()
    slow = Tokenizer.from_file(path)
    for files in ((path, ranks), (path, None)):
        got = packing.placed(packing.pack(cases.frame(spark, rows), *files)).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
            by_sequence[r.sequence_id].append((r.offset, r.length))
        want, total = defaultdict(list), 0
        for doc_id, text, *_ in rows:
            ids = [*slow.encode(text or "", add_special_tokens=False).ids, packing.END]
            total += len(ids)
            want[doc_id] += packing.pieces(ids)
        assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
        for places in by_sequence.values():
            places.sort()
            assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= packing.CAPACITY
        assert len(by_sequence) <= -(-total // packing.CAPACITY) + 1
    assert packing.pack(cases.empty(spark), path).count() == 0


def test_useful_sequences_are_those_that_best_fit_joins():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 60) if rng.random() < 0.3 else rng.randint(51, 100) for _ in range(rng.randint(0, 40))]
        counts = {u: sizes.count(u) for u in sizes}
        joined = [[sizes[i] for i in b] for b in packing.best_fit(sizes, 100)]
        assert packing.useful(counts, 100) == dict(Counter(u for b in joined if len(b) > 1 for u in b))


def test_rounds_lose_and_join_nothing_twice(spark):
    path, ranks = queries.tokenizer_files()
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "the", "of"], k=rng.randint(1, 90))), *[None] * 7) for i in range(300)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(24)
    got = packing.pack(docs, path, ranks, capacity=100).collect()
    assert sorted(m.doc_id for r in got for m in r.members) == list(range(300)) and len({r.sequence_id for r in got}) == len(got)
    assert all(r.used == sum(m.length for m in r.members) <= 100 and r.members[0].offset == 0 for r in got)
    used = [r.used for r in got]
    assert sum(2 * u <= 100 for u in used) <= 1 and len(used) <= 1.25 * sum(used) / 100


def test_pieces_and_best_fit():
    assert [p[:3] for p in packing.pieces(list(range(2500)))] == [(0, 0, 452), (1, 452, 1024), (2, 1476, 1024)]
    assert [p[:3] for p in packing.pieces(list(range(2048)))] == [(0, 0, 1024), (1, 1024, 1024)]
    rng = random.Random(1)
    sizes = [rng.randint(1, 1024) for _ in range(3000)]
    bins = packing.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= 1.02 * sum(sizes) / 1024 + 1


@pytest.mark.parametrize("text", ["Plain words, and 12 numbers!", "l'été ça y est\n\n  x\t", "don't we'll   ", "naïve — “quoted” … €5", " a", "中文 слово 😀　x y\u0085z", "<|endoftext|>"])
def test_both_encoders_agree(text):
    path, ranks = queries.tokenizer_files()
    assert packing.encoder(path, ranks)(text) == packing.encoder(path)(text)


def test_topics_are_found_on_all_documents(spark):
    docs = cases.frame(spark, [(i, f"{'common words of all ' * 3} {' '.join(f'w{i % 9}x{k}' for k in range(i % 7 + 3))}", *[None] * 7) for i in range(2600)])
    whole = mixing.fit_topics(docs).directions
    least = docs.orderBy(F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("long"), F.col("text"))).limit(2000)
    assert whole.shape == (mixing.COLUMNS, mixing.TOPICS) and np.abs(whole - mixing.fit_topics(docs.repartition(5)).directions).max() < 1e-3
    assert np.abs(whole - mixing.fit_topics(least).directions).max() > 1e-3
