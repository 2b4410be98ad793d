"""Fits of many training sets in one scan against one fit at a time in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import crossfit
from strandlake.operators.crossfit import Fit


def solve(x, y, w=None, c=1.0, penalise=True, standardise=True):
    """(weights of raw features, intercept) by damped Newton steps."""
    w = np.ones(len(y)) if w is None else w
    m, s = (x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)) if standardise else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    d = np.column_stack([(x - m) / s, np.ones(len(x))])
    r = np.append(np.full(x.shape[1], 1 / c), 1 / c if penalise else 0.0)
    f = lambda v: w @ (np.logaddexp(0, d @ v) - y * (d @ v)) + 0.5 * r @ (v * v)
    v = np.zeros(d.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(d @ v)))
        step = np.linalg.solve((d.T * (w * p * (1 - p))) @ d + np.diag(r) + 1e-12 * np.eye(len(v)), d.T @ (w * (p - y)) + r * v)
        t = 1.0
        while f(v - t * step) > f(v) + 1e-12 and t > 1e-9:
            t /= 2
        v = v - t * step
        if np.abs(step).max() < 1e-10:
            break
    return v[:-1] / s, v[-1] - (v[:-1] / s) @ m


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 240
    x = rng.normal(size=(n, 6)) * [1, 5, 0.1, 2, 1, 0] + [0, 3, -2, 0, 1, 7]
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.5 * x[:, 3] + rng.normal(size=n) * 2 > 1).astype(int)
    return x, y, rng.integers(0, 3, n), rng.integers(0, 2, n), rng.random(n) + 0.5


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold, inner, w = data
    out = [(k, float(r[0]), float(r[1]), [float(v) for v in r[2:]], int(y[k]), int(fold[k]), int(inner[k]), float(w[k])) for k, r in enumerate(x)]
    out += [(1000, 1.0, None, [0.0, 1.0, None, 7.0], None, 1, 0, 1.0)]
    return spark.createDataFrame(out, "row_idx long, a double, b double, v array<double>, label int, fold int, inner int, weight double").withColumn("_y", F.lit("mine")).drop("_y").repartition(5)


def test_cross_fits(rows, data):
    x, y, fold, _, _ = data
    models = {"ab": ["a", "b"], "all": ["a", "b", "v"], "a": ["a"]}
    own, other = crossfit.cross_fits(rows, models, 3, test=rows)
    own, other = ({r["row_idx"]: r for r in d.collect()} for d in (own, other))
    columns = {"ab": [0, 1], "all": range(6), "a": [0]}
    for m, c in columns.items():
        u = x[:, list(c)]
        for k in range(3):
            w, b = solve(u[fold != k], y[fold != k])
            for i in np.flatnonzero(fold == k):
                assert abs(own[i][f"p_{m}"] - sigmoid(u[i] @ w + b)) < 1e-9
        w, b = solve(u, y)
        assert max(abs(other[i][f"p_{m}"] - sigmoid(u[i] @ w + b)) for i in range(len(y))) < 1e-9
    assert own[1000]["p_ab"] is not None and set(own[0].asDict()) == {*rows.columns, "p_ab", "p_all", "p_a"}


def test_weights_penalties_and_separated_classes(rows, data):
    x, y, _, _, w = data
    got = crossfit.fit_all(rows, [Fit(("a", "b"))], weight="weight", c=0.3, penalise_intercept=False)
    want = solve(x[:, :2], y, w, 0.3, False)
    assert np.allclose(got.weights[0], want[0], atol=1e-9) and abs(got.intercepts[0] - want[1]) < 1e-9
    apart = rows.withColumn("label", (F.col("a") > 0).cast("int"))
    got = crossfit.fit_all(apart, [Fit(("a",))], c=1e8, penalise_intercept=False, standardise=False)
    want = solve(x[:, :1], (x[:, 0] > 0).astype(int), None, 1e8, False, False)
    assert np.allclose(got.weights[0], want[0], rtol=1e-4)
    with pytest.raises(RuntimeError):
        crossfit.fit_all(rows, [Fit(("a",))], rounds=1)


def test_nested(rows, data):
    x, y, fold, inner, _ = data
    out = {r["row_idx"]: r for r in crossfit.nested(rows.where("label IS NOT NULL"), ["a", "b"], ["v"], 3, 2).collect()}
    parts = {"first": x[:, :2], "second": x[:, 2:], "all": x}
    for k in range(3):
        train, test = fold != k, np.flatnonzero(fold == k)
        inside, outer = {}, {}
        for name, u in parts.items():
            w, b = solve(u[train], y[train])
            outer[name] = sigmoid(u[test] @ w + b)
            inside[name] = np.zeros(len(y))
            for j in range(2):
                w, b = solve(u[train & (inner != j)], y[train & (inner != j)])
                inside[name][inner == j] = sigmoid(u[inner == j] @ w + b)
        z = np.column_stack([logit(inside["first"][train]), logit(inside["second"][train])])
        w, b = solve(z, y[train], penalise=False, standardise=False)
        stack = sigmoid(logit(outer["first"]) * w[0] + logit(outer["second"]) * w[1] + b)
        grid = np.linspace(0, 1, 20001)
        loss = lambda t: np.mean(np.where(y[train] == 1, -np.log(t * inside["first"][train] + (1 - t) * inside["second"][train]), -np.log(1 - t * inside["first"][train] - (1 - t) * inside["second"][train])))  # noqa: B023, E731
        t = grid[np.argmin([loss(g) for g in grid])]
        for n, i in enumerate(test):
            r = out[i]
            for name in parts:
                assert abs(r[f"p_{name}"] - outer[name][n]) < 1e-9
            assert abs(r["p_mean"] - (outer["first"][n] + outer["second"][n]) / 2) < 1e-9
            assert abs(r["p_logit"] - sigmoid((logit(outer["first"][n]) + logit(outer["second"][n])) / 2)) < 1e-9
            assert abs(r["p_stack"] - stack[n]) < 1e-8
            assert abs(r["p_convex"] - (t * outer["first"][n] + (1 - t) * outer["second"][n])) < 1e-3


def test_external(rows, data):
    x, y, fold, _, _ = data
    train = rows.where("label IS NOT NULL")
    own, test = crossfit.external(train, train, {"a": ["a"], "b": ["b", "v"]}, ("a", "b"), 3)
    own, test = ({r["row_idx"]: r for r in d.collect()} for d in (own, test))
    z = np.array([[logit(own[k]["p_a"]), logit(own[k]["p_b"])] for k in range(len(y))])
    w, b = solve(z, y, penalise=False, standardise=False)
    for k in range(len(y)):
        t = test[k]
        assert abs(t["p_stack"] - sigmoid(logit(t["p_a"]) * w[0] + logit(t["p_b"]) * w[1] + b)) < 1e-8
        assert abs(own[k]["p_mean"] - (own[k]["p_a"] + own[k]["p_b"]) / 2) < 1e-12


def test_no_rows(rows):
    none = rows.limit(0)
    own, _ = crossfit.cross_fits(none, {"m": ["a"]}, 3)
    assert own.count() == 0
    own, test = crossfit.cross_fits(none, {"m": ["a"]}, 2, test=rows)
    assert test.where("p_m = 0.5").count() == 241
