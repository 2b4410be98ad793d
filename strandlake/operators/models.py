"""Fits and out-of-fold scores: penalised logistic models, forests and boosted trees, cross-fits and stacks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Logistic:
    """Weights on standardised features, the intercept last."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self) -> Column:
        z = F.lit(float(self.weights[-1]))
        for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=False):
            z = z + (F.col(f) - float(m)) / float(s) * float(w)
        return 1 / (1 + F.exp(-z))


def logistic(rows: DataFrame, features: list[str], c: float = 1.0, label: str = "label", weight: str | None = None, penalise_intercept: bool = True, rounds: int = 30) -> Logistic:
    """L2 logistic regression of standardised features with inverse strength c: the sum of losses times c plus half
    the squared weights, solved to convergence.

    Features are scaled by their population deviation, unweighted; a constant one keeps scale 1.  Newton's sums, as
    many as the square of the features, are taken by Spark in each round; only they reach the driver.
    penalise_intercept treats the intercept as a weight like others.
    """
    d = len(features)
    m = rows.agg(*(F.avg(f).alias(f"m{k}") for k, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features))).first()
    mean = np.array([m[f"m{k}"] or 0.0 for k in range(d)], float)
    scale = np.array([m[f"s{k}"] or 1.0 for k in range(d)], float)
    data = rows.select(*(F.col(f).cast("double") for f in features), F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    w = np.zeros(d + 1)
    ridge = np.ones(d + 1) / c
    if not penalise_intercept:
        ridge[-1] = 0.0

    def sums(at: np.ndarray):
        def run(batches):
            total = np.zeros((d + 1, d + 2))
            for b in batches:
                v = b.to_numpy(float)
                x = np.column_stack([(v[:, :d] - mean) / scale, np.ones(len(v))])
                p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
                total[:, :-1] += x.T * (v[:, -1] * p * (1 - p)) @ x
                total[:, -1] += x.T @ (v[:, -1] * (p - v[:, -2]))
            yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

        return run

    for _ in range(rounds):
        got = data.mapInPandas(sums(w), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy().reshape(d + 1, d + 2)
        step = np.linalg.solve(got[:, :-1] + np.diag(ridge) + 1e-12 * np.eye(d + 1), got[:, -1] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(features, mean, scale, w)


def forest(rows: DataFrame, features: list[str], trees: int = 100, label: str = "label") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, featureSubsetStrategy="sqrt", seed=42)]).fit(rows)


def boosted(rows: DataFrame, features: list[str], trees: int = 30, label: str = "label") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, seed=42)]).fit(rows)


def probability(model: PipelineModel | Logistic, rows: DataFrame, name: str = "probability") -> DataFrame:
    """Append the probability of class 1; helper columns go."""
    if isinstance(model, Logistic):
        return rows.withColumn(name, model.probability())
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.select(*(c for c in rows.columns if c != name), name)


def cross_fit(rows: DataFrame, fit, folds: int, fold: str = "fold") -> DataFrame:
    """Rows with the probability of a model that was fitted without their fold; fit takes a table, gives a model."""
    parts = [probability(fit(rows.where(F.col(fold) != k)), rows.where(F.col(fold) == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nested_stack(rows: DataFrame, fits: dict, folds: int, inner: int, fold: str = "fold", inner_fold: str = "inner") -> DataFrame:
    """Outer-fold probabilities of each branch, their equal-logit mean, and a logistic model on the branches' logits.

    In every outer fold the meta model learns from inner out-of-fold logits of the training rows only.
    """
    from ..functions.sequence import logit, sigmoid

    done = []
    names = list(fits)
    for k in range(folds):
        train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        meta = train
        for name, fit in fits.items():
            oof = cross_fit(train, fit, inner, inner_fold).select("row_idx", logit(F.col("probability")).alias(f"z_{name}"))
            meta = meta.join(oof, "row_idx")
            test = probability(fit(train), test, f"p_{name}").withColumn(f"z_{name}", logit(F.col(f"p_{name}")))
        z = [f"z_{n}" for n in names]
        test = probability(logistic(meta, z, penalise_intercept=False), test, "p_stack")
        done.append(test.withColumn("p_mean", sigmoid(sum((F.col(c) for c in z[1:]), F.col(z[0])) / len(z))))
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out


def refit_predict(train: DataFrame, test: DataFrame, fits: dict, folds: int, fold: str = "fold") -> DataFrame:
    """test with each branch's probability p_name, the equal-logit mean p_mean and the stack p_stack, of models of all
    of train; the stack learns from train's out-of-fold logits."""
    from ..functions.sequence import logit, sigmoid

    meta = train
    for name, fit in fits.items():
        meta = meta.join(cross_fit(train, fit, folds, fold).select("row_idx", logit(F.col("probability")).alias(f"z_{name}")), "row_idx")
        test = probability(fit(train), test, f"p_{name}").withColumn(f"z_{name}", logit(F.col(f"p_{name}")))
    z = [f"z_{n}" for n in fits]
    test = probability(logistic(meta, z, penalise_intercept=False), test, "p_stack")
    return test.withColumn("p_mean", sigmoid(sum((F.col(c) for c in z[1:]), F.col(z[0])) / len(z)))


def repeated_runs(rows: DataFrame, seeds: list[int], run) -> DataFrame:
    """The union of run(rows, seed) over the seeds, with a column seed."""
    parts = [run(rows, seed).withColumn("seed", F.lit(seed)) for seed in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def control_suite(rows: DataFrame, fits: dict, folds: int, fold: str = "fold", test: DataFrame | None = None, linear: dict[str, list[str]] | None = None) -> DataFrame:
    """Metrics of every model: (evaluation, model, metrics' columns), of out-of-fold scores and, given test, of its scores
    by models of all rows.

    linear names the features of penalised logistic models, which are fitted all at once; fits are functions that take a
    table and give a model, one fit to each fold and one to all rows.
    """
    from .crossfit import cross_fits
    from .metrics import metrics

    linear = linear or {}
    long: list[DataFrame] = []
    add = lambda df, evaluation, name, column: long.append(df.select(F.lit(evaluation).alias("evaluation"), F.lit(name).alias("model"), "label", F.col(column).alias("score")))
    if linear:
        own, other = cross_fits(rows, linear, folds, fold, test)
        for name in linear:
            add(own, "out_of_fold", name, f"p_{name}")
            if other is not None:
                add(other, "test", name, f"p_{name}")
    for name, fit in fits.items():
        add(cross_fit(rows, fit, folds, fold), "out_of_fold", name, "probability")
        if test is not None:
            add(probability(fit(rows), test), "test", name, "probability")
    every = long[0]
    for x in long[1:]:
        every = every.unionByName(x)
    return metrics(every, ["evaluation", "model"])


def ngram_logistic(rows: DataFrame, text: str, longest: int = 3, c: float = 1.0, label: str = "label") -> PipelineModel:
    """A penalised logistic model of counts of character n-grams up to longest; the vocabulary is that of rows alone."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, SQLTransformer

    grams = f"flatten(transform(sequence(1, {longest}), n -> IF(length(`{text}`) < n, CAST(array() AS array<string>), transform(sequence(1, greatest(1, length(`{text}`) - n + 1)), i -> substr(`{text}`, i, n)))))"
    n = max(1, rows.count())
    kinds = max(1, rows.select(F.explode(F.expr(grams)).alias("g")).distinct().count())  # the vocabulary has no other bound
    stages = [SQLTransformer(statement=f"SELECT *, {grams} AS _grams FROM __THIS__"), CountVectorizer(inputCol="_grams", outputCol="_x", minDF=1.0, vocabSize=kinds), LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False)]
    return Pipeline(stages=stages).fit(rows)


def principal_components(rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """rows with pc1 to pck: projections of the standardised features on their k principal components."""
    from pyspark.ml.feature import PCA, StandardScaler

    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), PCA(k=k, inputCol="_x", outputCol="_pc")]).fit(rows)
    out = model.transform(rows).withColumn("_pc", vector_to_array("_pc"))
    return out.select(*rows.columns, *(F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)))


def parameters(model: PipelineModel) -> dict[str, dict[str, object]]:
    """Parameters of every stage of a fitted pipeline, with values that JSON can hold."""
    plain = lambda v: v if isinstance(v, (bool, int, float, str, type(None))) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)
    return {f"{k}_{type(stage).__name__}": {p.name: plain(v) for p, v in stage.extractParamMap().items()} for k, stage in enumerate(model.stages)}


def save(model: PipelineModel | Logistic, path: str, spark) -> None:
    """A fitted model as a folder: Spark's own format, or one row of JSON for Logistic."""
    if isinstance(model, Logistic):
        row = (model.features, model.mean.tolist(), model.scale.tolist(), model.weights.tolist())
        spark.createDataFrame([row], "features array<string>, mean array<double>, scale array<double>, weights array<double>").write.mode("overwrite").json(path)
    else:
        model.write().overwrite().save(path)


def load(path: str, spark, kind: str = "pipeline") -> PipelineModel | Logistic:
    if kind == "pipeline":
        return PipelineModel.load(path)
    r = spark.read.schema("features array<string>, mean array<double>, scale array<double>, weights array<double>").json(path).first()
    return Logistic(r["features"], np.array(r["mean"]), np.array(r["scale"]), np.array(r["weights"]))


def overlap_weights(rows: DataFrame, features: list[str], label: str = "label", edge: float = 1e-6) -> DataFrame:
    """Append propensity and overlap_weight: one minus the propensity for class 1, the propensity for class 0."""
    e = probability(logistic(rows, features, label=label, penalise_intercept=False), rows, "propensity")
    p = F.least(F.greatest("propensity", F.lit(edge)), F.lit(1 - edge))
    return e.withColumn("propensity", p).withColumn("overlap_weight", F.when(F.col(label) == 1, 1 - F.col("propensity")).otherwise(F.col("propensity")))


def calibration_line(rows: DataFrame, score: str = "score", label: str = "label", rounds: int = 50) -> tuple[float, float]:
    """(intercept, slope) of the logistic fit of labels on logits, by Newton steps whose sums Spark takes."""
    from ..functions.sequence import logit, sigmoid

    z = rows.where(F.col(label).isin(0, 1)).select(logit(F.col(score)).alias("z"), F.col(label).cast("double").alias("y")).groupBy("z").agg(F.count("*").alias("n"), F.sum("y").alias("y")).cache()
    a, b = 0.0, 1.0
    for _ in range(rounds):
        p = sigmoid(F.lit(a) + F.col("z") * b)
        w, g = F.col("n") * p * (1 - p), F.col("y") - F.col("n") * p
        s = z.agg(F.sum(w).alias("h0"), F.sum(w * F.col("z")).alias("h1"), F.sum(w * F.col("z") * F.col("z")).alias("h2"), F.sum(g).alias("g0"), F.sum(g * F.col("z")).alias("g1")).first()
        det = s["h0"] * s["h2"] - s["h1"] ** 2
        if not det:
            break
        da, db = (s["h2"] * s["g0"] - s["h1"] * s["g1"]) / det, (s["h0"] * s["g1"] - s["h1"] * s["g0"]) / det
        longest = max(1.0, abs(da), abs(db))  # steps of at most 1 keep Newton from overshooting
        a, b = a + da / longest, b + db / longest
        if abs(da) + abs(db) < 1e-10:
            break
    z.unpersist()
    return a, b


def calibration_lines(rows: DataFrame, keys: list[str], score: str = "score", label: str = "label", c: float = 1e8, rounds: int = 160, tolerance: float = 1e-8) -> DataFrame:
    """(keys, intercept, slope) of logistic fits of labels on logits, for all keys at once, the slope penalised with inverse
    strength c, so that classes which logits separate have a line too.

    Every round of Newton's method is one grouped sum over distinct logits, joined with the lines still moving; no step
    more than doubles the line.  A key whose labels are all one, or whose scores are, has nulls.  A RuntimeError says that some did not settle.
    """
    from ..functions.sequence import logit, sigmoid
    from .grouping import _written

    z = rows.where(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, logit(F.col(score)).alias("z")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("y"))
    z = _written(z, "logits")
    ok = (F.sum("y") > 0) & (F.sum("y") < F.sum("n")) & (F.min("z") < F.max("z"))
    moving = z.groupBy(*keys).agg(ok.alias("ok"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("moved")).where("ok").drop("ok")
    settled = []
    for k in range(rounds):
        p = sigmoid(F.col("a") + F.col("z") * F.col("b"))
        w, g = F.col("n") * p * (1 - p), F.col("y") - F.col("n") * p
        s = z.join(moving, keys).groupBy(*keys, "a", "b").agg(F.sum(w).alias("h0"), F.sum(w * F.col("z")).alias("h1"), (F.sum(w * F.col("z") * F.col("z")) + 1 / c).alias("h2"), F.sum(g).alias("g0"), (F.sum(g * F.col("z")) - F.col("b") / c).alias("g1"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        s = s.withColumns({"da": F.try_divide(F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1"), det), "db": F.try_divide(F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0"), det)})
        s = s.withColumn("far", F.greatest(F.abs("da") / F.greatest(F.lit(1.0), F.abs("a")), F.abs("db") / F.greatest(F.lit(1.0), F.abs("b"))))
        longest = F.greatest(F.lit(1.0), F.col("far"))
        moving = s.select(*keys, (F.col("a") + F.col("da") / longest).alias("a"), (F.col("b") + F.col("db") / longest).alias("b"), F.col("far").alias("moved"))
        if k % 3 == 2:  # lineage is cut, and what has settled leaves
            now = _written(moving, "lines")
            settled.append(now.where(F.col("moved") <= tolerance))
            moving = now.where(~(F.col("moved") <= tolerance))
            if not moving.limit(1).count():
                break
    else:
        raise RuntimeError(f"lines did not settle in {rounds} rounds")
    fit = settled[0]
    for x in settled[1:]:
        fit = fit.unionByName(x)
    return z.select(*keys).distinct().join(fit.select(*keys, F.col("a").alias("intercept"), F.col("b").alias("slope")), keys, "left")


def calibration_bundle(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, metric, value): brier, log_loss, both calibration errors, calibration intercept and slope."""
    from .metrics import bin_table, ece, metrics

    names = ("brier", "log_loss", "ece_width", "ece_frequency", "calibration_intercept", "calibration_slope")
    errors = ece(bin_table(rows, keys, bins), keys).groupBy(*keys).pivot("scheme", ["width", "frequency"]).agg(F.max("ece"))
    wide = metrics(rows, keys).select(*keys, "brier", "log_loss").join(errors.withColumnsRenamed({"width": "ece_width", "frequency": "ece_frequency"}), keys)
    wide = wide.join(calibration_lines(rows, keys).withColumnsRenamed({"intercept": "calibration_intercept", "slope": "calibration_slope"}), keys)
    return wide.select(*keys, F.expr(f"stack({len(names)}, {', '.join(f"'{n}', `{n}`" for n in names)}) AS (metric, value)"))


def calibration_intervals(rows: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """(keys, metric, estimate, low, high): the bundle and its limits over class-stratified draws.

    Each value of keys draws with a seed of its own, made of seed and the value.
    """
    from ..functions.sequence import stable_seed
    from .grouping import _written
    from .resample import bootstrap, intervals

    own = stable_seed(seed, F.lit("calibration"), *keys)
    drawn = _written(bootstrap(rows.where(F.col("label").isin(0, 1)), replicates, own, keys=tuple(keys)), "draws")
    limits = intervals(calibration_bundle(drawn, [*keys, "replicate"]), [*keys, "metric"]).drop("median")
    return calibration_bundle(rows, keys).withColumnRenamed("value", "estimate").join(limits, [*keys, "metric"], "left")


def best_weight(rows: DataFrame, first: str, second: str, label: str = "label", steps: int = 100) -> float:
    """The convex weight of two probabilities with the least log loss: a grid in one pass, then a finer grid around."""
    low, high = 0.0, 1.0
    for _ in range(3):
        grid = [low + (high - low) * k / steps for k in range(steps + 1)]
        def loss(w):
            p = F.least(F.greatest(F.col(first) * w + F.col(second) * (1 - w), F.lit(1e-6)), F.lit(1 - 1e-6))
            return F.sum(F.when(F.col(label) == 1, -F.ln(p)).otherwise(-F.ln(1 - p)))
        got = rows.where(F.col(label).isin(0, 1)).agg(*(loss(w).alias(f"l{k}") for k, w in enumerate(grid))).first()
        k = min(range(steps + 1), key=lambda i: got[i])
        low, high = grid[max(0, k - 1)], grid[min(steps, k + 1)]
    return (low + high) / 2


def _documents(spark, sf_dir: str) -> tuple[DataFrame, list[str]]:
    from ..functions.sequence import RESIDUES, composition
    from ..jobs.frames import LOWER, UPPER, scored, table

    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), composition(F.translate(F.coalesce("text", F.lit("")), LOWER, UPPER)).alias("c"))
    rows = scored(spark, sf_dir).where("label IS NOT NULL").join(t, "row_idx").withColumn("length", F.col("length").cast("double"))
    names = [f"aac_{x}" for x in RESIDUES]
    return rows.select("row_idx", F.col("split").cast("int").alias("fold"), "label", "length", "score", *(F.col("c")[k].alias(n) for k, n in enumerate(names))), ["length", *names]


def document_oof(spark, sf_dir: str) -> DataFrame:
    from .crossfit import cross_fits

    rows, features = _documents(spark, sf_dir)
    own, _ = cross_fits(rows, {"both": features}, 5)
    return own.select("row_idx", "fold", "label", F.round("p_both", 4).alias("probability"))


def document_features(spark, sf_dir: str) -> DataFrame:
    """(row_idx, split, label, sequence, length, aac, dpc) of every labelled document's residue letters."""
    from ..functions.sequence import residues_of
    from ..jobs.frames import table
    from .features import handcrafted

    l = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("row_idx"), F.col("quality").cast("int").alias("label"))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), (F.col("doc_id") % 5).cast("int").alias("split"), residues_of(F.coalesce("text", F.lit(""))).alias("sequence"))
    return handcrafted(t.join(l, "row_idx"))


def document_controls(spark, sf_dir: str) -> DataFrame:
    """Simple representations as controls: out-of-fold scores in splits 1 to 4, and scores of split 0 as the test set."""
    from .grouping import _written

    rows = _written(document_features(spark, sf_dir).withColumn("fold", F.col("split") - 1), "controls")
    linear = {"length": ["length"], "composition": ["aac", "length"], "pairs": ["aac", "dpc", "length"]}
    trees = lambda t: Pipeline(stages=[VectorAssembler(inputCols=["_v"], outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=100, featureSubsetStrategy="sqrt", seed=42)]).fit(t)
    rows = rows.withColumn("_v", array_to_vector(F.concat("aac", "dpc", F.array("length"))))
    out = control_suite(rows.where("split > 0"), {"pairs_forest": trees}, 4, test=rows.where("split = 0"), linear=linear)
    return out.select("evaluation", "model", "n", "positives", *(F.round(c, 4).alias(c) for c in ("auc", "average_precision", "brier", "log_loss", "mcc")))


def document_overlap(spark, sf_dir: str) -> DataFrame:
    """Balance of all 24 descriptors, by weights of a propensity model of all of them.

    Charge, hydropathy and mass are those of a document's residue letters; a document without any has 0 for them, as
    it has for its shares.
    """
    from ..functions.sequence import RESIDUES, charge, gravy, molecular_weight
    from ..jobs.frames import LOWER, UPPER, table
    from .audit import balance
    from .grouping import _written

    rows, features = _documents(spark, sf_dir)
    letters = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), LOWER, UPPER), f"[^{RESIDUES}]", "")
    s = F.col("_s")
    more = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), letters.alias("_s")).select("row_idx", *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in (("charge", charge(s)), ("gravy", gravy(s)), ("weight", molecular_weight(s)))))
    features = [*features, "charge", "gravy", "weight"]
    rows = rows.join(more, "row_idx").na.fill({"length": 0.0})  # a null text is an empty one
    rows = _written(rows, "descriptors")  # each of Newton's rounds reads them
    w = overlap_weights(rows, features)
    b = balance(w, features, {"plain": F.lit(1.0), "overlap": F.col("overlap_weight")})
    return b.select("scheme", "feature", *(F.round(c, 4).alias(c) for c in ("positive_mean", "negative_mean", "smd")))
