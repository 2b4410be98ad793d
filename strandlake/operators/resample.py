"""Bootstraps, exact matching, shuffles and splits whose draws are hashes of their place, so any engine repeats them."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import hamming, unit_hash
from .metrics import metrics
from .ranked import numbered


def bootstrap(rows: DataFrame, replicates: int, seed: int | Column, label: str = "label", row: str = "row_idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """(replicate, rows' columns): each replicate draws as many rows of each class, with replacement.

    Draw k of a class takes the row number floor(m u) with u the hash of seed, replicate, class and k.  The draws are
    made from the rows themselves, one for each row and replicate, so they are spread like the rows.  Every value of
    keys is drawn from alone; seed may be an expression of them.  Null labels take no part.
    """
    rows = rows.where(F.col(label).isNotNull())
    by = [*keys, label]
    own = numbered(rows, by, [row])
    draws = own.select(*by, "k", "m").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = unit_hash(seed if isinstance(seed, Column) else F.lit(seed), "replicate", label, "k")
    picked = draws.select("replicate", *by, F.floor(u * F.col("m")).cast("int").alias("k"))
    return picked.join(own.drop("m"), [*by, "k"]).drop("k")


def intervals(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, low, median, high): percentiles of a value over replicates; nulls, which replicates may give, are left out."""
    q = lambda p: F.percentile(value, F.lit(p))
    return values.where(F.col(value).isNotNull()).groupBy(*keys).agg(q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"))


def _long(wide: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    return wide.select(*keys, F.expr(f"stack({len(names)}, {', '.join(f'"{n}", CAST(`{n}` AS DOUBLE)' for n in names)}) AS (metric, value)"))


def bootstrap_intervals(rows: DataFrame, models: list[str], replicates: int, seed: int, names: tuple[str, ...] = ("auc", "average_precision", "brier"), weight: str | None = None) -> DataFrame:
    """(model, metric, low, median, high): percentiles of each model's metrics over common replicates.

    weight, if given, travels with the rows that are drawn.
    """
    own = [weight] if weight else []
    long = bootstrap(rows, replicates, seed).select("replicate", "label", *own, F.expr(f"stack({len(models)}, {', '.join(f'"{m}", `{m}`' for m in models)}) AS (model, score)"))
    return intervals(_long(metrics(long, ["model", "replicate"], weight=weight, spread=False), ["model"], names), ["model", "metric"])


def cutoff_sensitivity(rows: DataFrame, identity: str, cutoffs: tuple[float, ...], replicates: int, seed: int, names: tuple[str, ...] = ("auc", "average_precision", "brier")) -> DataFrame:
    """(identity_cutoff, metric, estimate, low, high, n, positive_n, negative_n, retained_fraction) of the rows whose
    identity lies strictly below each cutoff.

    Each cutoff draws with its own seed, seed and its place added.  A cutoff that leaves fewer than two classes has one
    row, of metric "not_estimable".
    """
    levels = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("c"), F.lit(seed + k).alias("s")) for k, c in enumerate(cutoffs))))
    known = rows.where(F.col("label").isin(0, 1))
    each = known.select("row_idx", "label", "score", F.col(identity).alias("_i"), levels.alias("_l")).select("*", F.col("_l.c").alias("identity_cutoff"), F.col("_l.s").alias("_seed")).drop("_l")
    kept = F.coalesce(F.col("_i") < F.col("identity_cutoff"), F.lit(False))
    counts = each.groupBy("identity_cutoff").agg(F.count_if(kept).alias("n"), F.count_if(kept & (F.col("label") == 1)).alias("positive_n"), F.count_if(kept & (F.col("label") == 0)).alias("negative_n"), F.avg(kept.cast("double")).alias("retained_fraction"))
    enough = counts.where("positive_n > 0 AND negative_n > 0").select("identity_cutoff")
    left = each.where(kept).join(F.broadcast(enough), "identity_cutoff")  # a row to each cutoff
    keys = ["identity_cutoff"]
    point = _long(metrics(left, keys), keys, names).withColumnRenamed("value", "estimate")
    drawn = bootstrap(left, replicates, F.col("_seed"), keys=("identity_cutoff", "_seed"))
    limits = intervals(_long(metrics(drawn, [*keys, "replicate"], spread=False), keys, names), [*keys, "metric"]).drop("median")
    found = point.join(limits, [*keys, "metric"], "left")
    return counts.join(found, keys, "left").withColumn("metric", F.coalesce("metric", F.lit("not_estimable"))).select("identity_cutoff", "metric", "estimate", "low", "high", "n", "positive_n", "negative_n", "retained_fraction")


def match_frequency(rows: DataFrame, on: str, replicates: int, seed: int, row: str = "row_idx") -> DataFrame:
    """(row, times_selected, selection_fraction) of every row, over the matchings of matched()."""
    times = matched(rows, on, replicates, seed, row=row).groupBy(row).agg(F.count("*").alias("times_selected"))
    out = rows.select(row).join(times, row, "left").withColumn("times_selected", F.coalesce("times_selected", F.lit(0)))
    return out.withColumn("selection_fraction", F.col("times_selected") / F.lit(float(replicates)))


def match_summary(rows: DataFrame, on: str, replicates: int, seed: int, names: tuple[str, ...] = ("auc", "average_precision", "brier", "mcc")) -> DataFrame:
    """(metric, mean, sd, low, median, high) of metrics over the matchings of matched()."""
    long = _long(metrics(matched(rows, on, replicates, seed), ["replicate"], spread=False), [], names)
    spread = long.where("value IS NOT NULL").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return spread.join(intervals(long, ["metric"]), "metric")


def paired_deltas(rows: DataFrame, first: str, second: str, replicates: int, seed: int, names: tuple[str, ...] = ("auc", "brier")) -> DataFrame:
    """(metric, low, median, high) of first minus second on the same draws."""
    long = bootstrap(rows, replicates, seed).select("replicate", "label", F.expr(f"stack(2, 'a', `{first}`, 'b', `{second}`) AS (model, score)"))
    per = metrics(long, ["model", "replicate"], spread=False)
    flat = per.select("model", "replicate", F.expr(f"stack({len(names)}, {', '.join(f'"{n}", `{n}`' for n in names)}) AS (metric, value)"))
    gap = flat.groupBy("metric", "replicate").agg((F.max(F.when(F.col("model") == "a", F.col("value"))) - F.max(F.when(F.col("model") == "b", F.col("value")))).alias("value"))
    q = lambda p: F.percentile("value", F.lit(p))
    return gap.where("value IS NOT NULL").groupBy("metric").agg(q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"))


def matched(rows: DataFrame, on: str, replicates: int, seed: int, label: str = "label", row: str = "row_idx") -> DataFrame:
    """(replicate, rows' columns): of each value of on, as many rows of both classes, without replacement."""
    counts = rows.groupBy(on).agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("_take")).where("_take > 0")
    many = rows.join(counts, on).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    order = W.partitionBy("replicate", on, label).orderBy(unit_hash(F.lit(seed), "replicate", row), row)
    return many.withColumn("_r", F.row_number().over(order)).where("_r <= _take").drop("_r", "_take")


def match_counts(rows: DataFrame, on: str, label: str = "label") -> DataFrame:
    """(on, available_negative, available_positive, selected_per_class, shared)."""
    g = rows.groupBy(on).agg(F.count_if(F.col(label) == 0).alias("available_negative"), F.count_if(F.col(label) == 1).alias("available_positive"))
    return g.withColumn("selected_per_class", F.least("available_negative", "available_positive")).withColumn("shared", F.col("selected_per_class") > 0)


def shuffles(rows: DataFrame, replicates: int, seed: int, sequence: str = "sequence", row: str = "row_idx") -> DataFrame:
    """(row, replicate, sequence, shuffled, distance, repeated): orders of each sequence's own characters.

    Characters are ordered by a hash of seed, row, replicate and place, so composition never changes; repeated marks
    an order that an earlier replicate of the row had.
    """
    each = rows.select(row, F.col(sequence).alias("sequence")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    place = F.transform(F.split("sequence", ""), lambda c, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(row).cast("string"), F.col("replicate").cast("string"), i.cast("string"))).alias("h"), c.alias("c")))
    out = each.withColumn("shuffled", F.array_join(F.transform(F.array_sort(place), lambda x: x["c"]), ""))
    again = F.row_number().over(W.partitionBy(row, "shuffled").orderBy("replicate")) > 1
    return out.withColumn("distance", hamming(F.col("sequence"), F.col("shuffled"))).withColumn("repeated", again)


def shuffle_effect(rows: DataFrame, scored: DataFrame, row: str = "row_idx") -> DataFrame:
    """One row: what shuffling does to scores.  rows: row, label and score of originals; scored: row and score of shuffles.

    Originals without shuffles are left out.  auc_shuffled is of each original's mean shuffled score; change is that
    mean less the original's score.
    """
    mean = scored.groupBy(row).agg(F.count("*").alias("shuffles"), F.avg("score").alias("mean_score"))
    both = rows.select(row, "label", "score").join(mean, row)
    gap = F.col("mean_score") - F.col("score")
    of = lambda c: F.avg(F.when(F.col("label") == c, gap))
    change = both.agg(F.count("*").alias("originals"), F.sum("shuffles").alias("shuffles"), F.corr("score", "mean_score").alias("correlation"), F.avg(F.abs(gap)).alias("mean_absolute_change"), of(1).alias("positive_change"), of(0).alias("negative_change"))
    auc = lambda c, n: metrics(both.select("label", F.col(c).alias("score")), []).select(F.col("auc").alias(n))
    out = change.join(F.broadcast(auc("score", "auc"))).join(F.broadcast(auc("mean_score", "auc_shuffled")))  # one row each
    return out.withColumn("auc_drop", F.col("auc") - F.col("auc_shuffled"))


def shuffle_summary(ledger: DataFrame) -> DataFrame:
    """One row: draws, unchanged and repeated ones, mean, median and quantiles of the distance."""
    q = lambda p: F.percentile("distance", F.lit(p))
    return ledger.agg(F.count("*").alias("draws"), F.count_if(F.col("sequence") == F.col("shuffled")).alias("unchanged"), F.count_if("repeated").alias("repeats"), F.avg("distance").alias("mean_distance"), q(0.5).alias("median_distance"), q(0.025).alias("low"), q(0.975).alias("high"))


def split(rows: DataFrame, share: float, seed: int, label: str = "label", row: str = "row_idx") -> DataFrame:
    """Append part, "train" or "test": the share of each class that comes first by hash is train."""
    placed = numbered(rows.withColumn("_u", unit_hash(F.lit(seed), row)), [label], ["_u", row])
    place = F.col("k") / F.greatest(F.col("m") - 1, F.lit(1))
    return placed.withColumn("part", F.when(place < share, "train").otherwise("test")).drop("_u", "k", "m")


def generator_bootstrap(labels: list[int], replicates: int, seed: int, positive_first: bool = True) -> np.ndarray:
    """Row numbers of class-stratified draws by one NumPy generator in sequence: repeats published intervals."""
    y = np.asarray(labels)
    rng, order = np.random.default_rng(seed), ((1, 0) if positive_first else (0, 1))
    rows = {c: np.flatnonzero(y == c) for c in (0, 1)}
    return np.stack([np.concatenate([rng.choice(rows[c], len(rows[c]), replace=True) for c in order]) for _ in range(replicates)])


def rows_of_draws(spark, draws: np.ndarray) -> DataFrame:
    """(replicate, row_idx) of generator_bootstrap()."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"replicate": np.repeat(np.arange(len(draws)), draws.shape[1]), "row_idx": draws.ravel()}))


def _choices(counts: dict[str, int]) -> int:
    """Number of distinct orders of characters that occur so often."""
    out = math.factorial(sum(counts.values()))
    for n in counts.values():
        out //= math.factorial(n)
    return out


def order_at(text: str, index: int) -> str:
    """The distinct order of the characters of text with this index, from 0, in alphabetic order of all of them."""
    counts = dict(sorted(Counter(text).items()))
    ways, left, out = _choices(counts), len(text), []
    while left:
        for c, n in counts.items():
            own = ways * n // left  # orders that begin with c
            if index < own:
                break
            index -= own
        out.append(c)
        ways, left = own, left - 1
        counts[c] -= 1
    return "".join(out)


def order_index(text: str) -> int:
    """The inverse of order_at(): how many distinct orders of its characters come before text."""
    counts = dict(sorted(Counter(text).items()))
    ways, left, out = _choices(counts), len(text), 0
    for x in text:
        out += sum(ways * n // left for c, n in counts.items() if c < x)
        ways, left = ways * counts[x] // left, left - 1
        counts[x] -= 1
    return out


def drawn_orders(text: str, target: int, rng: random.Random) -> list[str]:
    """min(target, possible) distinct orders other than text, every set of them equally likely."""
    possible = _choices(Counter(text)) - 1
    if possible <= 2 * target:
        picked = rng.sample(range(possible), min(target, possible))
    else:
        picked = {}
        while len(picked) < target:
            picked[rng.randrange(possible)] = None
    own = order_index(text)
    return [order_at(text, k + (k >= own)) for k in picked]


def unique_shuffles(rows: DataFrame, target: int, seed: int, sequence: str = "sequence", row: str = "row_idx") -> DataFrame:
    """(row, shuffle_index, shuffled): min(target, possible) distinct orders other than the sequence itself.

    Indexes of orders are drawn without replacement and each order is computed from its index, so nothing is drawn
    twice or listed.  A null or empty sequence, or one of equal characters, has none.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for key, s in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                out += [(key, k, t) for k, t in enumerate(drawn_orders(s or "", target, random.Random(f"{seed}|{key}")))]
            yield pd.DataFrame(out, columns=["row_idx", "shuffle_index", "shuffled"])

    return rows.select(F.col(row).cast("long").alias("row_idx"), F.col(sequence)).mapInPandas(run, "row_idx long, shuffle_index int, shuffled string")
