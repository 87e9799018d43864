import random
import re
from fractions import Fraction

import numpy as np
import pytest

from blockwright.llm import ngram_join
from blockwright.llm.graph import components

from . import cases


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [r[0]]
        out.append((r[0], len(sets[i]), min((x for x in ids if x is not None), default=None)))
    return sorted(out, key=repr)


def test_components_are_those_of_brute_force(spark):
    rows = cases.documents(200, seed=4)
    got = ngram_join.near_groups(cases.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected(rows)


def test_heavy_keys_blocks_and_shared_numbers_change_nothing(spark, monkeypatch):
    rows = cases.documents(120, seed=9)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghi", k=6))
    passage = [word() for _ in range(200)]
    rows += [(5000 + i, " ".join([*passage, *(word() for _ in range(rng.choice([2, 60, 120])))]), *[None] * 7) for i in range(60)]
    want = expected(rows)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    for options in ({"bucket_keys": 3}, {"mask": 0xF}):
        got = ngram_join.near_groups(cases.frame(spark, rows), **options).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want, options


def test_a_passage_in_many_and_a_group_of_near_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghi", k=6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    rows = []
    for i in range(160):
        text = [word() for _ in range(rng.choice([8, 25, 60]))] + passage
        if i % 2:
            text = [w if rng.random() > 0.01 * (i % 5) else word() for w in base]
        rows.append((i, " ".join(text), *[None] * 7))
    got = ngram_join.near_groups(cases.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected(rows)


def test_what_a_meeting_writes_does_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghi", k=6))
    passage = [word() for _ in range(160)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(29 if i % 10 else 24))]), *[None] * 7) for i in range(120)]  # just below the threshold, or with the shorter ones just above
    written = []
    kept = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: (made := kept(df, name), written.append((name, made.count())))[0])
    got = ngram_join.near_groups(cases.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected(rows)
    assert max(n for name, n in written if name in ("met", "pairs")) <= 10 * len(rows)  # of 7140 pairs


@pytest.mark.parametrize("strays", [0, 6])
def test_classes_that_meet_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, strays):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghi", k=6))
    base, rows = [word() for _ in range(150)], []
    for i in range(160):  # up to four changed words in two texts together leave a link, more don't
        text = list(base)
        for at in rng.sample(range(150), 12 if i < strays else 1 + i % 3):
            text[at] = word()
        rows.append((i, " ".join(text), *[None] * 7))
    want, written, kept = expected(rows), [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: (made := kept(df, name), written.append((name, made.count())))[0])
    met = []
    for block in (512, 8):
        written.clear()
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.near_groups(cases.frame(spark, rows)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
        met.append(sum(n for name, n in written if name == "meetings"))
    assert met[1] <= 3 * met[0] + 20 * strays  # 20 blocks


def test_empty(spark):
    assert ngram_join.near_groups(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20, 47, 48, 63, 64, 70, 190, 255, 256, 300, 900, 1024, 5000])
def test_sets_that_link_share_a_key_and_pass_the_screen(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        drop = rng.integers(0, max(1, len(a) // 5) + 1)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 64, rng.integers(0, n // 4 + 1), dtype=np.uint64)]))
        common = np.sort(np.concatenate([ngram_join.sketch_words(a, c)[::3] for c in ngram_join.bands(len(a))]))
        if len(b) and ngram_join.linked(a, b):
            for late in (np.zeros(0, np.uint64), common):
                assert len(np.intersect1d(ngram_join.keys(a, late), ngram_join.keys(b, late)))
            assert ngram_join.possible(len(a), ngram_join.bits(a), len(b), ngram_join.bits(b))
            assert ngram_join.distance(ngram_join.bits(a), ngram_join.bits(b)) <= len(np.setxor1d(a, b))


def test_threshold_is_exact():
    a, b = np.arange(7, dtype=np.uint64), np.arange(1, 7, dtype=np.uint64)
    assert ngram_join.linked(a[:3], np.arange(4, dtype=np.uint64))  # 3 of 4
    assert not ngram_join.linked(a[:2], np.arange(3, dtype=np.uint64))
    assert ngram_join.linked(a, b, Fraction(6, 7)) and not ngram_join.linked(a, b, Fraction(7, 8))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
