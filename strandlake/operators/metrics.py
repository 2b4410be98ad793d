"""Ranking, threshold and calibration metrics of scores, by any keys, weighted or not.

Every metric comes from sums over distinct scores, so ties are exact and no key's rows meet in one task unsummed.
Null or NaN scores and labels other than 0 and 1 are left out; metrics without a defined value are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranked import numbered, running, tile


def clean(scores: DataFrame, label: str, score: str) -> DataFrame:
    return scores.where(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score))


def metrics(scores: DataFrame, keys: list[str], label: str = "label", score: str = "score", weight: str | None = None, threshold: float = 0.5, strict: bool = False, edge: float = 1e-6, clip_brier: bool = True, spread: bool = True) -> DataFrame:
    """One row for each value of keys: counts, threshold metrics (recall is sensitivity), auc, average precision, brier and log loss.

    strict compares score > threshold instead of >=.  edge clips probabilities for the log loss, and for the Brier
    score too if clip_brier.  spread ranges the distinct scores of each key over many tasks; without it each key is one
    window, which suits many keys, such as replicates.
    """
    rows = clean(scores, label, score)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, p = F.col(label), F.col(score).cast("double")
    hit = (p > threshold) if strict else (p >= threshold)
    c = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    b = c if clip_brier else p
    at = rows.groupBy(*keys, p.alias("_p"), hit.alias("_hit")).agg(
        F.count("*").alias("n"),
        F.sum(F.when(y == 1, w).otherwise(0.0)).alias("wp"),
        F.sum(F.when(y == 0, w).otherwise(0.0)).alias("wn"),
        F.sum(F.col(label).cast("long")).alias("np"),
        F.sum(w * w).alias("ww"),
        F.sum(w * F.pow(b - y, 2)).alias("se"),
        F.sum(-w * F.when(y == 1, F.ln(c)).otherwise(F.ln(1 - c))).alias("ll"),
    )
    if spread:
        run = running(at, keys, [F.desc("_p")], ["wp", "wn"]).withColumnsRenamed({"run_wp": "cp", "run_wn": "cn"})
    else:
        down = W.partitionBy(*keys).orderBy(F.desc("_p"))
        run = at.withColumn("cp", F.sum("wp").over(down)).withColumn("cn", F.sum("wn").over(down))
    g = run.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("np").alias("positives"), F.sum("wp").alias("all_p"), F.sum("wn").alias("all_n"),
        F.sum(F.col("wn") * (F.col("cp") - F.col("wp") / 2)).alias("area"),
        F.sum(F.col("wp") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("prec"),
        F.sum(F.when(F.col("_hit"), F.col("wp")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("_hit"), F.col("wn")).otherwise(0.0)).alias("fp"),
        F.sum("ww").alias("ww"), F.sum("se").alias("se"), F.sum("ll").alias("ll"),
    )
    g = g.withColumns({"fn": F.col("all_p") - F.col("tp"), "tn": F.col("all_n") - F.col("fp")})
    d = F.try_divide
    tp, fp, fn, tn, P, N = (F.col(k) for k in ("tp", "fp", "fn", "tn", "all_p", "all_n"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    mcc = zero(d(tp * tn - fp * fn, F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0))))
    return g.select(
        *keys, "n", "positives", (F.col("n") - F.col("positives")).alias("negatives"), d(F.pow(P + N, 2), F.col("ww")).alias("effective_n"),
        d(F.col("area"), P * N).alias("auc"), d(F.col("prec"), P).alias("average_precision"),
        d(tp + tn, P + N).alias("accuracy"), zero(d(tp, tp + fp)).alias("precision"), zero(d(tp, P)).alias("recall"), d(tn, N).alias("specificity"), d(zero(d(tp, P)) + d(tn, N), F.lit(2.0)).alias("balanced_accuracy"),
        zero(d(2 * tp, 2 * tp + fp + fn)).alias("f1"), mcc.alias("mcc"), d(F.col("se"), P + N).alias("brier"), d(F.col("ll"), P + N).alias("log_loss"), "tp", "fp", "tn", "fn",
    )


def auc_by_rank(scores: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """AUC from average ranks: the Mann-Whitney form, over distinct scores."""
    at = clean(scores, label, score).groupBy(*keys, F.col(score).alias("_p")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("np"))
    ranked = running(at, keys, [F.asc("_p")], ["n"]).withColumn("rank", F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2)
    g = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("np")).alias("r"), F.sum("np").alias("p"), F.sum("n").alias("n"))
    return g.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def width_edges(bins: int) -> list[float]:
    """Edges k / bins as a linear spacing computes them: k times the step."""
    step = 1.0 / bins
    return [k * step for k in range(bins)] + [1.0]


def width_bin(p: Column, bins: int) -> Column:
    """Bin of p among equal widths, left edge inside, the last one closed; from the edges' doubles themselves."""
    e = width_edges(bins)
    out = F.lit(0)
    for k in range(1, bins):
        out = F.when(p >= e[k], k).otherwise(out)
    return out


def with_frequency_bin(scores: DataFrame, keys: list[str], bins: int, score: str, row: str) -> DataFrame:
    """Equal-frequency bins by score and then row: the first bins get what is over.

    Rows that repeat score and row may change places: they are the same row, drawn twice.
    """
    placed = numbered(scores, keys, [score, row])
    return placed.withColumn("bin", tile(F.col("k"), F.col("m"), bins)).drop("k", "m")


def bin_table(scores: DataFrame, keys: list[str], bins: int = 10, label: str = "label", score: str = "score", row: str = "row_idx") -> DataFrame:
    """(keys, scheme, bin, n, mean_score, observed_rate, gap) of both schemes; empty width bins stay, with nulls."""
    rows = clean(scores, label, score)
    sums = [F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed_rate")]
    width = rows.withColumn("bin", width_bin(F.col(score), bins)).groupBy(*keys, "bin").agg(*sums)
    every = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = every.join(width, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("scheme", F.lit("width"))
    freq = with_frequency_bin(rows, keys, bins, score, row).groupBy(*keys, "bin").agg(*sums).withColumn("scheme", F.lit("frequency"))
    both = width.unionByName(freq)
    return both.select(*keys, "scheme", F.col("bin").cast("int").alias("bin"), "n", "mean_score", "observed_rate", F.abs(F.col("mean_score") - F.col("observed_rate")).alias("gap"))


def ece(table: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error of each scheme of a bin_table()."""
    return table.groupBy(*keys, "scheme").agg(F.try_divide(F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))), F.sum("n")).alias("ece"))
