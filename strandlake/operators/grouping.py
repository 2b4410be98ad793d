"""Groups of similar rows and folds that never split a group."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the folder of spark.checkpoint.dir; a temporary one where that is unset, on one machine only."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _discard(df: DataFrame) -> None:
    """Delete a table of _written() that no later plan reads."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(row_idx, first_index, group_index, group_size) of every node of row_idx under edges (l_idx, r_idx).

    first_index is the least row_idx that is reachable, group_index its dense rank from 0.  Each round every node takes
    the least label of itself, its neighbours and its label's label; rounds end when nothing changes.
    """
    both = _written(edges.select(F.col("l_idx").alias("a"), F.col("r_idx").alias("b")).unionByName(edges.select(F.col("r_idx").alias("a"), F.col("l_idx").alias("b"))).distinct(), "edges")
    label = _written(nodes.select(F.col("row_idx").cast("long").alias("a"), F.col("row_idx").cast("long").alias("c")), "labels")
    written = label
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("n"))
        step = label.join(near, "a", "left").select("a", F.least("c", F.coalesce("n", "c")).alias("c2"), "c")
        jump = step.select(F.col("a").alias("c2"), F.col("c2").alias("c3"))
        new = _written(step.join(jump, "c2").select("a", F.least("c2", "c3").alias("c"), (F.least("c2", "c3") != F.col("c")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        _discard(written)
        written, label = new, new.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError("labels did not settle")
    heads = label.groupBy("c").agg(F.count("*").alias("group_size"))
    ranked = dense_index(heads, "c")
    return label.join(ranked, "c").select(F.col("a").alias("row_idx"), F.col("c").alias("first_index"), "group_index", "group_size")


def dense_index(rows: DataFrame, by: str, parts: int = 64) -> DataFrame:
    """Append group_index, the rank of the distinct column by from 0, without a window over all rows.

    Rows are ranged into parts; a part's offset is the count of the parts before it.
    """
    ranged = _written(rows.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # at most parts rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("_part").orderBy(by)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("group_index", F.col("_own") + F.col("_before")).drop("_part", "_n", "_before", "_own")


def leader_groups(nodes: DataFrame, edges: DataFrame, length: str = "length", text: str = "sequence", max_rounds: int = 1000) -> DataFrame:
    """(row_idx, leader): greedy clustering in the order of longer, then alphabetic, then first rows.

    A row is a leader unless an earlier leader links to it; others join their earliest linked leader.  Each round
    settles all rows whose earlier neighbours are settled, so the result is that of the one-by-one rule.
    edges: (l_idx, r_idx) in any direction.
    """
    order = F.struct((-F.col(length)).alias("l"), F.col(text).alias("t"), F.col("row_idx").alias("i"))
    o = nodes.select(F.col("row_idx").cast("long").alias("row_idx"), order.alias("o"))
    both = edges.select(F.col("l_idx").alias("a"), F.col("r_idx").alias("b")).unionByName(edges.select(F.col("r_idx").alias("a"), F.col("l_idx").alias("b"))).distinct()
    # Arcs from each row to the earlier ones it links to.
    arcs = _written(both.join(o.select(F.col("row_idx").alias("a"), F.col("o").alias("oa")), "a").join(o.select(F.col("row_idx").alias("b"), F.col("o").alias("ob")), "b").where("ob < oa").select("a", "b", "ob"), "arcs")
    state = _written(o.select("row_idx", F.lit(None).cast("boolean").alias("leader")), "leaders")
    for _ in range(max_rounds):
        seen = arcs.join(state.withColumnRenamed("row_idx", "b"), "b").groupBy("a").agg(F.max(F.coalesce("leader", F.lit(False)).cast("int")).alias("some"), F.count_if(F.col("leader").isNull()).alias("open"))
        new = state.join(seen.withColumnRenamed("a", "row_idx"), "row_idx", "left").select("row_idx", F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.coalesce("some", F.lit(0)) == 1, F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True)).alias("leader"))
        state = _written(new, "leaders")
        if not state.where("leader IS NULL").limit(1).count():
            break
    else:
        raise RuntimeError("leaders did not settle")
    joined = arcs.join(state.where("leader").select(F.col("row_idx").alias("b")), "b").groupBy("a").agg(F.min("ob").alias("o"))
    return state.join(joined.withColumnRenamed("a", "row_idx"), "row_idx", "left").select("row_idx", F.when(F.col("leader"), F.col("row_idx")).otherwise(F.col("o.i")).alias("leader"))


def assign_folds(counts: np.ndarray, k: int, seed: int | None, mode: str = "permute_groups") -> np.ndarray:
    """Fold of every group from its class counts (groups x classes).

    Groups of most uneven counts come first; each goes to the fold that leaves class shares most even over folds,
    and among equals to the fold with fewest rows.  mode "permute_groups" shuffles groups with their counts before;
    "permute_counts" shuffles the rows of counts alone, as one published run did; seed None does neither.
    """
    n, own = len(counts), counts.astype(float)
    ids = np.arange(n)
    if seed is not None:
        order = np.random.RandomState(seed).permutation(n)
        own = own[order]
        if mode == "permute_groups":
            ids = order
    folds, total, fold_of = np.zeros((k, counts.shape[1])), counts.sum(0).astype(float), np.zeros(n, int)
    for g in np.argsort(-own.std(axis=1), kind="mergesort"):
        best = (np.inf, np.inf, 0)
        for f in range(k):
            folds[f] += own[g]
            spread = (folds / total).std(axis=0).mean()
            size = folds[f].sum()
            folds[f] -= own[g]
            if spread < best[0] or (np.isclose(spread, best[0]) and size < best[1]):
                best = (spread, size, f)
        folds[best[2]] += own[g]
        fold_of[ids[g]] = best[2]
    return fold_of


def group_folds(rows: DataFrame, k: int, seed: int | None, group: str = "group_index", label: str = "label", mode: str = "permute_groups", limit: int = 2_000_000) -> DataFrame:
    """rows with fold.  Spark counts classes of each group; the greedy rule runs over those counts, at most limit groups."""
    counts = rows.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("c0"), F.count_if(F.col(label) == 1).alias("c1")).orderBy(group).limit(limit + 1).toPandas()
    if len(counts) > limit:
        raise ValueError(f"more than {limit} groups")
    out = pd.DataFrame({group: counts[group], "fold": assign_folds(counts[["c0", "c1"]].to_numpy(), k, seed, mode)})
    return rows.join(rows.sparkSession.createDataFrame(out), group)


def fold_audit(rows: DataFrame, group: str = "group_index", label: str = "label") -> DataFrame:
    """Per fold: rows, classes and groups of both sides, and groups on both sides (0 if folds are sound)."""
    per = rows.groupBy("fold").agg(F.count("*").alias("valid_n"), F.count_if(F.col(label) == 1).alias("valid_positive"), F.count_if(F.col(label) == 0).alias("valid_negative"), F.countDistinct(group).alias("valid_groups"))
    shared = rows.select(group, "fold").distinct().withColumn("in_folds", F.count("*").over(W.partitionBy(group))).groupBy("fold").agg(F.count_if(F.col("in_folds") > 1).alias("shared_groups"))
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"), F.countDistinct(group).alias("g"))  # one row
    out = per.join(shared, "fold").join(F.broadcast(total))
    return out.select("fold", (F.col("n") - F.col("valid_n")).alias("train_n"), "valid_n", (F.col("p") - F.col("valid_positive")).alias("train_positive"), "valid_positive", "valid_negative", (F.col("g") - F.col("valid_groups") + F.col("shared_groups")).alias("train_groups"), "valid_groups", "shared_groups")
