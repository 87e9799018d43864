"""Each stage of corpus_pipeline against a plain version on its own input."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from blockwright.llm import exact_dedup, mixing, quality

from . import cases
from .test_ngram_join import shingles


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again as the pipeline's are."""
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "exact_dedup", "ngram_join", "mixing", "packing"]
    for before, after in list(stages.values())[:-1]:
        assert before.schema == after.schema and 0 < after.count() < before.count()


def test_quality_keeps_what_scores_well(spark, stages):
    before, after = stages["quality"]
    scored = quality.classify(before, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.filter("predicted = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 0").collect()}
    assert len(bad & {r.doc_id for r in after.collect()}) < 0.1 * len(bad)


def test_one_of_equal_texts_stays(stages):
    before, after = stages["exact_dedup"]
    by = defaultdict(list)
    for r in before.collect():
        by[re.sub("[ \t-\r]+", " ", r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(v) for v in by.values())


def test_one_of_near_copies_stays(stages):
    before, after = stages["ngram_join"]
    rows = sorted((r.doc_id, shingles(r.text)) for r in before.collect())
    by_shingle, parent = defaultdict(list), {d: d for d, _ in rows}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in rows:
        shared = defaultdict(int)
        for x in s:
            for other in by_shingle[x]:
                shared[other] += 1
            by_shingle[x].append((d, len(s)))
        for (other, n), c in shared.items():
            if 100 * c >= 75 * (len(s) + n - c):
                a, b = sorted((find(d), find(other)))
                parent[b] = a
    assert sorted(r.doc_id for r in after.collect()) == [d for d, _ in rows if find(d) == d]


def test_draws_follow_the_probabilities(stages):
    before, after = stages["mixing"]
    want = {r.id for r in mixing.mix(before, budget=corpus_pipeline.BUDGET).filter("selected").collect()}
    assert {r.doc_id for r in after.collect()} == want
    tokens = lambda df: mixing.described(df).selectExpr("sum(tokens)").first()[0]
    assert 0.7 < tokens(after) / tokens(before) < 0.9


def test_all_documents_are_packed(stages):
    before, after = stages["packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    used = defaultdict(int)
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and sum(used.values()) / len(used) > 0.95 * 1024


def test_stages_take_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(4, 1), (7, 0), (10, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    for docs in (cases.frame(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, sf)
            n = out.count()
            assert (out.columns == docs.columns) or name == "packing"
            assert (n > 0) == (docs.count() > 0), name
        assert corpus_pipeline.good_quality(spark, docs, sf).columns == docs.columns
    docs = cases.frame(spark)
    kept = corpus_pipeline.one_of_each_text(spark, docs, sf).collect()
    assert len(kept) == sum(r.kept for r in exact_dedup.exact_groups(*exact_dedup.halves(docs)).collect())


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, stages["packing"][1].collect()))
