"""Running sums and row numbers within keys, however few the keys: two passes over ranges instead of one window.

Rows are ranged by keys and order into parts, written, and summed within each part; a part's offset is the sum of the
parts before it.  Only one row of each key and part is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouping import _written


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which nulls are equal too."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, on).drop(*(f"_right_{k}" for k in keys))


def running(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Append run_c for each column c: its sum over the rows of the same keys up to this one, in an order without ties."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _written(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    local = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_sum_{c}") for c in columns))
    offsets = sums.select("_part", *keys, *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns))
    both = join_same(ranged.withColumns({f"run_{c}": F.sum(c).over(local) for c in columns}), offsets, ["_part", *keys])
    return both.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"_before_{c}") for c in columns}).drop("_part", *(f"_before_{c}" for c in columns))


def numbered(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Append k, the number of a row within by from 0 in an order without ties, and m, their count."""
    out = running(rows.withColumn("_one", F.lit(1).cast("long")), by, [F.col(o) if isinstance(o, str) else o for o in order], ["_one"])
    counts = rows.groupBy(*by).agg(F.count("*").alias("m"))
    return join_same(out.withColumn("k", F.col("run__one") - 1).drop("_one", "run__one"), counts, by)


def tile(k: Column, m: Column, bins: int) -> Column:
    """Which of so many bins of equal size row k of m lies in, from 0; the first bins get what is over."""
    size, over = F.floor(m / bins), m % bins
    wide = over * (size + 1)
    return F.when(k < wide, F.floor(k / (size + 1))).otherwise(over + F.floor(F.try_divide(k - wide, size))).cast("int")
