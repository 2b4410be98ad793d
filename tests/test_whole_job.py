"""Operators and queries over everything that they are given."""

import numpy as np

from strandlake.functions import sequence as X
from strandlake.functions.sequence import RESIDUES
from strandlake.operators import audit, models


def test_every_pair_of_splits(spark):
    rows = [(0, "a"), (0, "b"), (1, "b"), (2, "a"), (2, "c"), (3, "c"), (3, "c"), (4, "c"), (4, None), (3, None), (None, "a")]
    texts = {k: {t for s, t in rows if s == k} for k in range(5)}
    want = {(a, b, side): n for a in range(5) for b in range(a + 1, 5) for side, n in (("both", len(texts[a] & texts[b])), ("left", len(texts[a] - texts[b])), ("right", len(texts[b] - texts[a])))}
    got = audit.overlaps(spark.createDataFrame(rows, "split long, sequence string")).collect()
    assert {(r["left_split"], r["right_split"], r["side"]): r["n"] for r in got} == want and len(got) == 30


def descriptors(text):
    up = text.upper()
    s = "".join(c for c in up if c in RESIDUES)
    charge = 0.0
    if s:
        plus, minus = (lambda pk: 1 / (1 + 10 ** (7 - pk))), (lambda pk: 1 / (1 + 10 ** (pk - 7)))
        charge = plus(X.PK_N_END.get(s[0], 7.5)) - minus(X.PK_C_END.get(s[-1], 3.55)) + sum(plus(X.PK_POSITIVE[c]) for c in s if c in X.PK_POSITIVE) - sum(minus(X.PK_NEGATIVE[c]) for c in s if c in X.PK_NEGATIVE)
    gravy = sum(X.HYDROPATHY[c] for c in s) / max(1, len(s))
    weight = sum(X.MASS[c] for c in s) - (len(s) - 1) * X.WATER if s else 0.0
    return [len(text), *(up.count(r) / max(1, len(up)) for r in RESIDUES), charge, gravy, weight]


def test_overlap_weights_of_every_descriptor(spark, tmp_path):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list(RESIDUES + " "), int(rng.integers(30, 60)))) + "k" * int(rng.integers(0, 4 + 4 * (k % 2))) for k in range(400)] + ["", None]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["scheme"], r["feature"]): r for r in models.document_overlap(spark, str(tmp_path)).collect()}
    names = ["length", *(f"aac_{x}" for x in RESIDUES), "charge", "gravy", "weight"]
    assert set(got) == {(s, n) for s in ("plain", "overlap") for n in names}
    x, y = np.array([descriptors(t or "") for t in texts]), np.arange(len(texts)) % 2
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    w, ridge = np.zeros(25), np.diag([1.0] * 24 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (p - y) + ridge @ w)
    v = np.where(y == 1, 1 - p, p)
    for k, n in enumerate(names):
        for scheme, u in (("plain", np.ones(len(y))), ("overlap", v)):
            for c, column in ((1, "positive_mean"), (0, "negative_mean")):
                assert abs(got[scheme, n][column] - np.average(x[y == c, k], weights=u[y == c])) < 6e-5
    assert abs(got["plain", "charge"]["smd"]) > 0.5 and abs(got["overlap", "charge"]["smd"]) < 0.1
