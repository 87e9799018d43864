import re
from collections import defaultdict

import numpy as np
import pytest

from blockwright.llm import exact_dedup

from . import cases


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 60000])
def test_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    made = exact_dedup.FuseFilter.build(np.concatenate([keys, keys[: n // 2]]))
    assert made.hits(keys).all()
    other = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert made.hits(other).mean() < 0.02 or n < 3
    if n >= 5000:
        assert len(made.cells) < 1.4 * n


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub("[ \t-\r]+", " ", text or "")].append(doc_id)
    out = []
    for members in groups.values():
        known = [m for m in members if m is not None]
        keep = min(known) if known else None
        out += [(m, keep, len(members)) for m in members]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("bits", [256, 8])
def test_groups_are_those_of_brute_force(spark, bits):
    rows = cases.documents(60 if bits == 8 else 120)
    got = exact_dedup.exact_groups(*exact_dedup.halves(cases.frame(spark, rows)), bits=bits).collect()
    want, groups = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups


def test_parts_may_be_empty(spark):
    docs = cases.frame(spark)
    n = docs.count()
    for old, new in ((docs, cases.empty(spark)), (cases.empty(spark), docs)):
        assert exact_dedup.exact_groups(old, new).count() == n
    assert exact_dedup.exact_groups(cases.empty(spark), cases.empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [256, 8])
def test_a_kept_snapshot_takes_many_batches(spark, tmp_path, bits):
    old = cases.documents(80, seed=2)
    exact_dedup.build_snapshot(cases.frame(spark, old), str(tmp_path / "kept"), bits)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*")}
    for seed in (2, 3):
        new = [(1000 + i, *r[1:]) for i, r in enumerate(cases.documents(40, seed=seed))] + [(2000, "only here", *[None] * 7)]
        kept = exact_dedup.open_snapshot(spark, str(tmp_path / "kept"))
        got = exact_dedup.groups_with(kept, cases.frame(spark, new)).collect()
        want, groups = expected(old + new)
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
        assert sum(r.kept for r in got) == groups
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*")}
