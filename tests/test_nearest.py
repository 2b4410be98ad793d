"""Best-first nearest alignments against all pairs."""

import numpy as np
import pytest

from strandlake.operators import similarity


def test_bounds_hold():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("ACDEFGHIK*é"), rng.integers(1, 14))) for _ in range(60)]
    u = similarity.bounds(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            _, _, _, identity, coverage = similarity.align(a, b)
            assert identity * coverage <= u[i, j] + 1e-12


@pytest.mark.parametrize("by_product, floor, identity", [(False, 0.8, 0.0), (True, 0.8, 0.6), (False, 0.3, 0.9), (False, 0.0, 0.0)])
def test_equal_to_all_pairs(spark, monkeypatch, by_product, floor, identity):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 10)
    monkeypatch.setattr(similarity, "POOL_BLOCK", 40)
    monkeypatch.setattr(similarity, "ROUND", 3)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("ACDEFGHIKLMN"), rng.integers(1, 12))) for _ in range(110)] + ["", "W", "*", "ACDEFGHIK", "ACDEFGHIK"]
    rows = spark.createDataFrame(list(enumerate(words)), "row_idx long, sequence string")
    queries, pool = rows.where("row_idx % 5 = 0"), rows.where("row_idx % 5 != 0")
    counted: dict = {}
    got = {r["l_idx"]: r for r in similarity.nearest(queries, pool, floor, identity, by_product, counted).collect()}
    for i, a in enumerate(words):
        if i % 5:
            continue
        every = [(j, *similarity.align(a, b)) for j, b in enumerate(words) if j % 5]
        every = [x for x in every if x[1] > 0]
        best = lambda xs, p: max(xs, key=lambda x: ((x[4] * x[5],) if p else ()) + (x[4], x[5], x[1], -x[0]), default=None)
        for prefix, x in (("", best(every, by_product)), ("eligible_", best([x for x in every if x[5] + 1e-12 >= floor and x[4] + 1e-12 >= identity], False))):
            r = got[i]
            if x is None:
                assert (r[f"{prefix}r_idx"], r[f"{prefix}score"]) == (None, 0)
            else:
                assert (r[f"{prefix}r_idx"], r[f"{prefix}score"]) == (x[0], x[1]) and r[f"{prefix}identity"] == pytest.approx(x[4]) and r[f"{prefix}coverage"] == pytest.approx(x[5])
    assert counted["pairs"] == len(got) * (len(words) - len(got)) and counted["aligned"] <= counted["pairs"]
