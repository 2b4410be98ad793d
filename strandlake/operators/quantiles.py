"""Exact quantiles of groups of any size, by narrowing value ranges instead of sorting or collecting a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouping import _discard, _written

#: Parts of a range in a pass, and values of a range that are few enough to be sorted.
PARTS, FEW = 1024, 10_000


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], parts: int = PARTS, few: int = FEW) -> DataFrame:
    """(keys, share, quantile): linearly interpolated quantiles, as percentile() gives them, of every group.

    A quantile lies between two ranks.  A pass counts the values of every range that holds a wanted rank in parts
    equal parts, and goes on with the part where the rank is, between its least and greatest value; ranges of one value
    are done, and those of few values are sorted.  So no task holds a group, however large.  Nulls and NaN are left
    out, and groups without other values; null keys are a group; infinite values raise.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    v = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    # Null keys join like others: keys travel as one struct.
    v = v.select(F.struct(*names).alias("_g") if names else F.struct(F.lit(0).alias("_k")).alias("_g"), "_v")
    span = v.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))
    span = span.withColumn("n", F.when(F.greatest(F.abs("a"), F.abs("b")) == math.inf, F.raise_error("infinite value")).otherwise(F.col("n")))
    wanted = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * s), F.ceil((F.col("n") - 1) * s)) for s in shares)))))
    span = _written(span, "spans")
    open_ = span.select("_g", wanted.alias("k"), "a", "b", F.lit(0).cast("long").alias("before"), F.col("n").alias("size"))
    done, scratch = [], []
    while True:
        open_ = _written(open_, "ranks")
        scratch.append(open_)
        wide = (F.col("a") < F.col("b")) & (F.col("size") > few)
        done.append(open_.where(~wide))
        if not open_.where(wide).limit(1).count():
            break
        now = open_.where(wide)
        ranges = now.select(F.col("_g").alias("_h"), "a", "b").distinct()
        part = F.least(F.floor((F.col("_v") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2) * parts), F.lit(parts - 1))
        inside = v.join(ranges, v["_g"].eqNullSafe(ranges["_h"]) & (F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b")))
        counts = inside.groupBy(F.col("_g").alias("_h"), "a", "b", part.alias("part")).agg(F.count("*").alias("size"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = counts.withColumn("upto", F.sum("size").over(W.partitionBy("_h", "a", "b").orderBy("part"))).withColumnsRenamed({"a": "_a", "b": "_b", "size": "_size"})
        at = F.col("k") - F.col("before")
        hit = now.join(upto, now["_g"].eqNullSafe(upto["_h"]) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).where((at < F.col("upto")) & (at >= F.col("upto") - F.col("_size")))
        open_ = hit.select("_g", "k", F.col("lo").alias("a"), F.col("hi").alias("b"), (F.col("before") + F.col("upto") - F.col("_size")).alias("before"), F.col("_size").alias("size"))
    last = done[0]
    for d in done[1:]:
        last = last.unionByName(d)
    ranges = last.where("a < b").select(F.col("_g").alias("_h"), "a", "b").distinct()
    inside = v.join(ranges, v["_g"].eqNullSafe(ranges["_h"]) & (F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b")))
    placed = inside.select("_h", F.col("a").alias("_a"), F.col("b").alias("_b"), "_v", (F.row_number().over(W.partitionBy("_h", "a", "b").orderBy("_v")) - 1).alias("_place"))  # few values a range
    sorted_ = last.where("a < b").join(placed, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("k") - F.col("before") == F.col("_place"))).select("_g", "k", F.col("_v").alias("x"))
    ranked = last.where("a = b").select("_g", "k", F.col("a").alias("x")).unionByName(sorted_)
    table = ranked.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("_m"))  # two ranks a share
    table = table.select(F.col("_g").alias("_h"), "_m")
    each = span.join(table, span["_g"].eqNullSafe(table["_h"])).select("_g", "n", "_m", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    place = (F.col("n") - 1) * F.col("share")
    low, high = F.try_element_at("_m", F.floor(place)), F.try_element_at("_m", F.ceil(place))
    out = _written(each.select(*(F.col("_g")[n].alias(k) for k, n in zip(keys, names, strict=True)), "share", (low + (high - low) * (place - F.floor(place))).alias("quantile")), "quantiles")
    for d in scratch:
        _discard(d)
    return out
