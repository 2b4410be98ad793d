"""Penalised logistic models of many training sets at once.

Cross-fits, nested stacks and external protocols fit one model to many parts of the same rows.  Here every Newton round
of all models and parts is one scan: a task adds up each fit's sums over its rows, Spark adds the tasks' sums, and only
those, as many as the square of a fit's features, reach the driver, which solves for the steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.sequence import logit, sigmoid
from .grouping import _written


@dataclass(frozen=True)
class Fit:
    """A model of these features, learnt from the rows whose columns differ from all values of without."""

    features: tuple[str, ...]
    without: tuple[tuple[str, int], ...] = ()


def designed(rows: DataFrame, features: list[str], width: dict[str, int] | None = None) -> tuple[DataFrame, dict[str, slice]]:
    """rows with _x, the features side by side (null: 0), and where each stands.  A feature is a number or an array of numbers, all of one
    length, which width gives or the first row tells."""
    wide = [f for f in features if isinstance(rows.schema[f].dataType, ArrayType)]
    unknown = [f for f in wide if f not in (width or {})]
    first = rows.select(*(F.size(f).alias(f) for f in unknown)).first() if unknown else None
    places, at, parts = {}, 0, []
    for f in features:
        size = 1 if f not in wide else (width or {}).get(f) or (first[f] if first else 0)
        places[f] = slice(at, at + size)
        at += size
        parts.append(F.transform(f, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))) if f in wide else F.array(F.coalesce(F.col(f).cast("double"), F.lit(0.0))))
    return rows.withColumn("_x", F.concat(*parts)), places


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Fitted:
    """Weights of raw features and intercepts of fits, a row to each."""

    def __init__(self, places: dict[str, slice], fits: list[Fit], weights: np.ndarray, intercepts: np.ndarray):
        self.places, self.fits, self.weights, self.intercepts = places, fits, weights, intercepts

    def probabilities(self, rows: DataFrame, name: str = "_p") -> DataFrame:
        """rows with the array of all fits' probabilities."""
        w, b, out, width = self.weights.T.copy(), self.intercepts, name, self.weights.shape[1]
        rows, _ = designed(rows, list(self.places), {f: s.stop - s.start for f, s in self.places.items()})
        rows = rows.drop(name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = _matrix(batch.column("_x"), width) @ w + b
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                keep = [k for k, n in enumerate(batch.schema.names) if n != "_x"]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), lists], names=[*(batch.schema.names[k] for k in keep), out])

        return rows.mapInArrow(run, rows.drop("_x").schema.add(name, ArrayType(rows.schema["_x"].dataType.elementType)))


def fit_all(rows: DataFrame, fits: list[Fit], label: str = "label", weight: str | None = None, c: float = 1.0, penalise_intercept: bool = True, standardise: bool = True, rounds: int = 100, tolerance: float = 1e-9) -> Fitted:
    """All fits to convergence: each minimises c times its loss plus half its squared weights.

    With standardise, features are scaled by mean and population deviation of the fit's own rows, unweighted, and constant ones
    keep scale 1.  Rows without a label of 0 or 1 take no part.  Newton's steps are halved while they would raise the
    objective, so separated classes converge too.  A RuntimeError says that the rounds did not suffice.
    """
    features = list(dict.fromkeys(f for x in fits for f in x.features))
    splits = sorted({n for f in fits for n, _ in f.without})
    data, places = designed(rows.where(F.col(label).isin(0, 1)), features)
    data = _written(data.select("_x", F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), *(F.col(s).cast("long").alias(f"_s{k}") for k, s in enumerate(splits))), "design")
    width = max((s.stop for s in places.values()), default=0)
    # A task's sums are as large as its fits' squared features: tasks hold at least as many rows as features.
    data = data.coalesce(max(1, data.count() // max(1, width)))
    use = [np.concatenate([np.arange(places[f].start, places[f].stop) for f in x.features]) for x in fits]
    out_of = [[(splits.index(n), v) for n, v in x.without] for x in fits]
    sizes = [len(u) for u in use]

    def inside(cells: np.ndarray, k: int) -> np.ndarray:
        """Which rows, by their split columns, fit k learns from."""
        keep = np.ones(len(cells), bool)
        for s, v in out_of[k]:
            keep &= cells[:, s] != v
        return keep

    mean, scale = _moments(data, width, len(splits), inside, len(fits)) if standardise else (np.zeros((len(fits), width)), np.ones((len(fits), width)))
    ridge = [np.append(np.full(d, 1 / c), 1 / c if penalise_intercept else 0.0) for d in sizes]
    upper = [np.triu_indices(d + 1) for d in sizes]

    def sums(at: dict[int, np.ndarray], hessian: bool):
        """Loss, gradient and upper Hessian of the fits in at, side by side."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                x, y, w = _matrix(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy()
                cells = np.column_stack([b.column(3 + s).fill_null(-1).to_numpy() for s in range(len(splits))]) if splits else np.zeros((len(x), 0))
                for k, v in at.items():
                    mine = inside(cells, k)
                    own = np.column_stack([(x[mine][:, use[k]] - mean[k, use[k]]) / scale[k, use[k]], np.ones(int(mine.sum()))])
                    z, yy, ww = own @ v, y[mine], w[mine]
                    loss = ww @ (np.logaddexp(0, z) - yy * z)
                    parts = [np.array([loss])]
                    if hessian:
                        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                        parts += [own.T @ (ww * (p - yy)), (own.T @ ((ww * p * (1 - p))[:, None] * own))[upper[k]]]
                    got = np.concatenate(parts)
                    total[k] = total[k] + got if k in total else got
            for k, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int64)), pa.array(v)], names=["fit", "k", "v"])

        got = data.mapInArrow(run, "fit int, k long, v double").groupBy("fit", "k").agg(F.sum("v").alias("v")).toArrow().sort_by([("fit", "ascending"), ("k", "ascending")])
        which, values = got.column("fit").to_numpy(), got.column("v").to_numpy()
        return {k: values[which == k] for k in at if (which == k).any()}

    beta = {k: np.zeros(d + 1) for k, d in enumerate(sizes)}
    least: dict[int, float] = {}
    step = {k: np.zeros(d + 1) for k, d in enumerate(sizes)}
    open_ = {*beta}
    for _ in range(rounds):
        got = sums({k: beta[k] + step[k] for k in open_}, True)
        for k in list(open_):
            if k not in got:  # no rows
                open_.discard(k)
                continue
            at = beta[k] + step[k]
            objective = got[k][0] + 0.5 * ridge[k] @ (at * at)
            if k in least and objective > least[k] + 1e-12 * abs(least[k]):
                step[k] = step[k] / 2
                if np.abs(step[k]).max() < tolerance:
                    open_.discard(k)
                continue
            beta[k], least[k] = at, objective
            d = sizes[k] + 1
            h = np.zeros((d, d))
            h[upper[k]] = got[k][1 + d :]
            h = h + np.triu(h, 1).T + np.diag(ridge[k]) + 1e-12 * np.eye(d)
            step[k] = -np.linalg.solve(h, got[k][1 : 1 + d] + ridge[k] * at)
            if np.abs(step[k]).max() < tolerance:
                beta[k] = at + step[k]
                open_.discard(k)
        if not open_:
            break
    else:
        raise RuntimeError(f"{len(open_)} of {len(fits)} fits did not converge in {rounds} rounds")
    weights, intercepts = np.zeros((len(fits), width)), np.zeros(len(fits))
    for k, u in enumerate(use):
        weights[k, u] = beta[k][:-1] / scale[k, u]
        intercepts[k] = beta[k][-1] - weights[k, u] @ mean[k, u]
    return Fitted(places, fits, weights, intercepts)


def _moments(data: DataFrame, width: int, splits: int, inside, fits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of every feature in every fit's rows, from those of the splits' cells."""
    keys = [f"_s{k}" for k in range(splits)]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in batches:
            x = _matrix(b.column(0), width)
            cells = np.column_stack([b.column(3 + s).fill_null(-1).to_numpy() for s in range(splits)]) if splits else np.zeros((len(x), 0), np.int64)
            kinds, of = np.unique(cells, axis=0, return_inverse=True) if splits else (cells[:1], np.zeros(len(x), int))
            for k, cell in enumerate(kinds):
                own = x[of.ravel() == k]
                m = own.mean(0)
                new = [len(own), m, ((own - m) ** 2).sum(0)]
                old = total.get(tuple(cell.tolist()))
                total[tuple(cell.tolist())] = _pooled(old, new) if old else new
        for cell, (n, m, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([list(cell)], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([m.tolist()], pa.list_(pa.float64())), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["cell", "n", "m", "s"])

    parts = data.mapInArrow(run, "cell array<long>, n long, m array<double>, s array<double>").collect()  # a row to each task and cell
    mean, scale = np.zeros((fits, width)), np.ones((fits, width))
    cells = np.array([p["cell"] for p in parts], np.int64).reshape(len(parts), len(keys))
    order = sorted(range(len(parts)), key=lambda i: (parts[i]["cell"], parts[i]["n"], parts[i]["m"]))
    for k in range(fits):
        keep, total = inside(cells, k), None
        for i in order:
            if keep[i]:
                new = [parts[i]["n"], np.array(parts[i]["m"]), np.array(parts[i]["s"])]
                total = _pooled(total, new) if total else new
        if total:
            deviation = np.sqrt(total[2] / total[0])
            mean[k], scale[k] = total[1], np.where(deviation > 1e-12 * np.maximum(1, np.abs(total[1])), deviation, 1.0)
    return mean, scale


def _pooled(a: list, b: list) -> list:
    """Size, mean and squared deviations of two parts together."""
    n, d = a[0] + b[0], b[1] - a[1]
    return [n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)]


def cross_fits(rows: DataFrame, models: dict[str, list[str]], folds: int, fold: str = "fold", test: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """(rows with p_<model> of fits without their fold, test with p_<model> of fits to all rows): all fits in one go.

    Rows of a fold outside 0 to folds - 1 have null probabilities.
    """
    fits = [Fit(tuple(f), ((fold, k),)) for f in models.values() for k in range(folds)] + ([Fit(tuple(f)) for f in models.values()] if test is not None else [])
    fitted = fit_all(rows, fits, **options)
    known = F.col(fold).between(0, folds - 1)
    own = fitted.probabilities(rows).withColumns({f"p_{m}": F.when(known, F.get("_p", F.col(fold).cast("int") + i * folds)) for i, m in enumerate(models)}).drop("_p")
    if test is None:
        return own, None
    base = folds * len(models)
    return own, fitted.probabilities(test).withColumns({f"p_{m}": F.get("_p", F.lit(base + i)) for i, m in enumerate(models)}).drop("_p")


def convex_weights(rows: DataFrame, pairs: dict[str, tuple[Column, Column]], label: str = "label", weight: str | None = None, rounds: int = 60) -> dict[str, float]:
    """For every pair of probabilities (nulls: left out) the weight of the first, between 0 and 1, whose mixture has the least log loss.

    The loss is convex in the weight: each round halves all pairs' intervals by the sign of its slope, in one scan.
    """
    edge = 1e-6
    data = _written(rows.where(F.col(label).isin(0, 1)).select(F.col(label).alias("_y"), (F.col(weight) if weight else F.lit(1.0)).alias("_w"), *(c.alias(f"{p}{k}") for k, x in enumerate(pairs.values()) for p, c in zip("ab", x, strict=True))), "pairs")
    span = [(0.0, 1.0)] * len(pairs)
    for _ in range(rounds):
        at = [(lo + hi) / 2 for lo, hi in span]

        def slope(k: int) -> Column:
            a, b = F.col(f"a{k}"), F.col(f"b{k}")
            p = F.lit(at[k]) * a + F.lit(1 - at[k]) * b
            s = F.when(F.col("_y") == 1, -1 / p).otherwise(1 / (1 - p)) * (a - b)
            return F.sum(F.when((p > edge) & (p < 1 - edge), s * F.col("_w")).otherwise(0.0))

        got = data.agg(*(slope(k).alias(f"s{k}") for k in range(len(pairs)))).first()
        span = [(lo, m) if (got[f"s{k}"] or 0.0) > 0 else (m, hi) for k, ((lo, hi), m) in enumerate(zip(span, at, strict=True))]
        if max(hi - lo for lo, hi in span) < 1e-9:
            break
    return {n: (lo + hi) / 2 for n, (lo, hi) in zip(pairs, span, strict=True)}


def nested(rows: DataFrame, first: list[str], second: list[str], folds: int, inner: int, fold: str = "fold", inner_of: str = "inner", label: str = "label", weight: str | None = None, **options) -> DataFrame:
    """rows with seven out-of-fold probabilities: of two branches, of all features together, and of four fusions.

    p_first, p_second, p_all; p_mean and p_logit, the equal means of probabilities and of logits; p_convex, a mixture
    whose weight, and p_stack, a logistic model whose weights were learnt from the branches' inner out-of-fold scores in
    the training rows of the fold.  inner_of is a column of inner folds, or an array of them by outer fold.  All branch
    fits are one call of fit_all(), all stacks another.
    """
    rows = _written(rows, "nested")
    splits = isinstance(rows.schema[inner_of].dataType, ArrayType)
    data = rows.withColumns({f"_i{k}": F.get(inner_of, F.lit(k)) if splits else F.col(inner_of) for k in range(folds)})
    branches = {"first": tuple(first), "second": tuple(second)}
    fits, at = [], {}
    for k in range(folds):
        for name, f in branches.items():
            for j in range(inner):
                at[name, k, j] = len(fits)
                fits.append(Fit(f, ((fold, k), (f"_i{k}", j))))
        for name, f in (*branches.items(), ("all", tuple(dict.fromkeys((*first, *second))))):
            at[name, k] = len(fits)
            fits.append(Fit(f, ((fold, k),)))
    scored = fit_all(data, fits, label=label, weight=weight, **options).probabilities(data)
    pick = lambda places, by: F.get("_p", F.get(F.array(*map(F.lit, places)), by.cast("int")))
    inside = {(n, k): F.when(F.col(fold) != k, pick([at[n, k, j] for j in range(inner)], F.col(f"_i{k}"))) for n in branches for k in range(folds)}
    scored = scored.withColumns({f"p_{n}": pick([at[n, k] for k in range(folds)], F.col(fold)) for n in ("first", "second", "all")})
    scored = _written(scored.withColumns({f"_q_{n}_{k}": c for (n, k), c in inside.items()}).drop("_p"), "inner")
    z = scored.withColumns({f"_z_{n}_{k}": logit(F.coalesce(f"_q_{n}_{k}", F.lit(0.5))) for n in branches for k in range(folds)})
    stacks = fit_all(z, [Fit((f"_z_first_{k}", f"_z_second_{k}"), ((fold, k),)) for k in range(folds)], label=label, weight=weight, penalise_intercept=False, standardise=False)
    mix = convex_weights(scored, {str(k): (F.col(f"_q_first_{k}"), F.col(f"_q_second_{k}")) for k in range(folds)}, label, weight)
    own = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), F.col(fold).cast("int"))
    a, b = logit(F.col("p_first")), logit(F.col("p_second"))
    w = own([mix[str(k)] for k in range(folds)])
    coefficient = lambda n: own([stacks.weights[k, stacks.places[f"_z_{n}_{k}"].start] for k in range(folds)])
    out = {
        "p_mean": (F.col("p_first") + F.col("p_second")) / 2,
        "p_logit": sigmoid((a + b) / 2),
        "p_convex": w * F.col("p_first") + (1 - w) * F.col("p_second"),
        "p_stack": sigmoid(own(stacks.intercepts) + a * coefficient("first") + b * coefficient("second")),
    }
    return scored.withColumns(out).select(*rows.columns, "p_first", "p_second", "p_all", *out)


def external(train: DataFrame, test: DataFrame, models: dict[str, list[str]], fuse: tuple[str, str], folds: int, fold: str = "fold", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(train with out-of-fold scores, test with scores of models of all of train), p_<model> and fusions of two models.

    Fusions are p_mean and p_logit, equal means of probabilities and logits, and on test p_stack, a logistic model that
    learns from train's out-of-fold logits.
    """
    own, other = cross_fits(train, models, folds, fold, test, label=label)
    own = _written(own, "external")
    x, y = (f"p_{n}" for n in fuse)
    z = own.withColumns({"_z_a": logit(F.col(x)), "_z_b": logit(F.col(y))})
    stack = fit_all(z, [Fit(("_z_a", "_z_b"))], label=label, penalise_intercept=False, standardise=False)
    a, b = logit(F.col(x)), logit(F.col(y))
    fused = {"p_mean": (F.col(x) + F.col(y)) / 2, "p_logit": sigmoid((a + b) / 2)}
    first, second = (float(stack.weights[0, stack.places[n].start]) for n in ("_z_a", "_z_b"))
    return own.withColumns(fused), other.withColumns(fused | {"p_stack": sigmoid(float(stack.intercepts[0]) + a * first + b * second)})
