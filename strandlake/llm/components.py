"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two shuffled groupings of edges; nothing of the graph reaches the driver but counts.  A hub with
very many edges is met by aggregating its minimum first and joining it back, never by gathering its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _star(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """One star step: link each neighbour of u that qualifies to the least node of u's neighbourhood."""
    a = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if small:
        nearby = a
    else:
        nearby = a.unionByName(a.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = nearby.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = nearby.join(least, "u").coalesce(tasks)
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct().coalesce(tasks)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    edges: columns u and v of one ordered type, in any direction.  Loops, nulls and repeated edges are dropped;
    without edges the result is empty.  A RuntimeError says that the rounds did not settle.
    """
    now = C.materialize(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    n = now.count()
    if not n:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tasks, mark = C.width(2 * n, least=2), None  # a small graph's rounds write few files
    for _ in range(max_rounds):
        new = C.materialize(_star(_star(now, False, tasks), True, tasks), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        C.discard(now)
        now = new
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled: every node but the least of its component points at the least.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
