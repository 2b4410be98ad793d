"""Nearest neighbours by adaptive dimension scans of probed lists.

Vectors are rotated at random and assigned to the nearest of the centroids that a bounded sample gives.  A query
probes the lists of its nearest centroids: as many as reach TARGET recall between vectors of the sample that placed no
centroid.  In a list, stored as column blocks of the rotated dimensions, a scan adds one block of dimensions at a time
to all candidates' partial distances; after each block the hypothesis test of random projections drops a candidate
whose partial distance already says, at the given significance, that its full one exceeds the query's tenth best so
far (Gao and Long, 2023).  What survives is measured exactly, in double precision on original vectors.

Queries visit their lists in two waves.  The tenth best of the FIRST nearest lists is carried into the second wave,
where it drops candidates from the first block on, and skips lists that lie wholly beyond it by the triangle inequality.

Equal vectors are searched once: a class stands for its copies, of which the TOP + 1 smallest ids suffice.  Lists
are dealt to tasks in parts of a bounded number of vectors, queries in parts of a bounded number too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C

TOP = 10
#: Vectors sampled to place centroids and to measure recall, of which one in HOLD_OUT places none.
SAMPLE, HOLD_OUT = 20_000, 4
#: Recall between held-out sample vectors that the number of probed lists must reach, and queries that measure it.
TARGET, MEASURED = 0.95, 400
#: Lists of the first wave.
FIRST = 2
#: Vectors and queries of one task's part of a list.
PART, QUERY_PART = 2048, 4096
BLOCK_DIMS = 16
#: The test's epsilon: a candidate goes if partial / sqrt(d / D) exceeds (1 + EPSILON / sqrt(d)) times the threshold.
EPSILON = 2.1


def usable(vector: Column, dims: int) -> Column:
    """Not null, of the table's dimension, finite everywhere and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def centroids_of(sample: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm on the bounded sample, in the rotated space."""
    rng = np.random.default_rng(5)
    centers = sample[rng.permutation(len(sample))[:count]].copy()
    for _ in range(rounds):
        near = nearest_lists(sample, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest_lists(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of every row, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (centers**2).sum(1) - 2 * x[a : a + 4096] @ centers.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def probes_for(held: np.ndarray, centers: np.ndarray, top: int, target: float = TARGET) -> int:
    """How many nearest lists hold at least target of the true neighbours among vectors that placed no centroid.

    They are a sample, farther apart than the vectors searched, so the figure errs on the side of more lists.
    """
    if len(held) < 2:
        return len(centers)
    queries = held[:MEASURED]
    d = (queries**2).sum(1)[:, None] + (held**2).sum(1) - 2 * queries @ held.T
    d[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    k = min(top, len(held) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    ranks = np.argsort(nearest_lists(queries, centers, len(centers)), axis=1)
    of = nearest_lists(held, centers, 1)[:, 0]
    need = np.sort(ranks[np.arange(len(queries))[:, None], of[near]], axis=None)
    return int(need[math.ceil(target * len(need)) - 1]) + 1


def scan(queries: np.ndarray, vectors: np.ndarray, top: int, carried: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) positions that survive the adaptive scan of one part of a list, rotated on both sides.

    carried: each query's best bound so far on the squared distance of its top-th neighbour.
    """
    dims = vectors.shape[1]
    cuts = [*range(0, dims, BLOCK_DIMS), dims]
    columns = [np.ascontiguousarray(vectors[:, a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    norms = (columns[0] ** 2).sum(1)
    carried = np.full(len(queries), np.inf) if carried is None else carried
    keep_q, keep_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 19) // max(1, len(vectors)))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        first, best = q[:, : cuts[1]], carried[a : a + step].copy()
        part = (first**2).sum(1)[:, None] + norms - 2 * first @ columns[0].T
        if len(vectors) > top:
            # Exact distances of the candidates that look nearest after the first block bound the best from above.
            lead = np.argpartition(part, top - 1, axis=1)[:, :top]
            best = np.minimum(best, np.array([((vectors[x] - y) ** 2).sum(1).max() for x, y in zip(lead, q, strict=True)]))
        slack = 1e-12 * ((first**2).sum(1)[:, None] + norms)
        i, v = np.nonzero(part - slack <= (best * _allowed(cuts[1], dims))[:, None])
        part = ((columns[0][v] - first[i]) ** 2).sum(1)
        for block, at, done in zip(columns[1:], cuts[1:-1], cuts[2:], strict=True):
            part = part + ((block[v] - q[i, at:done]) ** 2).sum(1)
            ok = part <= best[i] * _allowed(done, dims)
            i, v, part = i[ok], v[ok], part[ok]
        keep_q.append(i + a)
        keep_v.append(v)
    return np.concatenate(keep_q), np.concatenate(keep_v)


def _allowed(done: int, dims: int) -> float:
    """The multiple of the best squared distance that a squared partial distance over so many dimensions may have."""
    return 1 + 1e-9 if done >= dims else (done / dims) * (1 + EPSILON / math.sqrt(done)) ** 2


def _matrix(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, dims))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def search(vectors: DataFrame, is_query: Column, top: int = TOP, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query among all rows but its own.

    Nearest first, ties to the smaller id; score is the Euclidean distance of the original vectors in double
    precision.  Null, zero, non-finite and wrongly sized vectors and null ids take no part, as queries neither; the
    dimension is the most frequent one.  Rows that repeat an id and its vector count once.  With fewer candidates than
    top all are returned.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if common is None or not common["d"]:
        return spark.createDataFrame([], shape)
    dims = common["d"]
    rows = rows.where(usable(F.col("x"), dims))
    # Classes of equal vectors, each with its smallest ids: two steps, so that a hot class is never gathered whole.
    rows = rows.select("id", "x", F.xxhash64("x").alias("h"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, top + 1)
    salted = rows.withColumn("r", F.dense_rank().over(W.partitionBy("h", "x", "salt").orderBy("id"))).where(F.col("r") <= top + 1)
    classes = salted.groupBy("h", "x", "salt").agg(few(F.collect_set("id")).alias("ids")).groupBy("h", "x").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    classes = C.materialize(classes.select(F.col("ids")[0].alias("class"), "ids", "x"), "vectors")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], shape)
    place = F.pmod(F.xxhash64("class", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    turn = rotation(dims)
    sample = _matrix(classes.where(place < min(1.0, SAMPLE / n)).orderBy("class").limit(2 * SAMPLE).select("x").toArrow()["x"].combine_chunks(), dims) @ turn
    if not len(sample):
        sample = _matrix(classes.orderBy("class").limit(1).toArrow()["x"].combine_chunks(), dims) @ turn
    sample = sample[np.random.default_rng(7).permutation(len(sample))]
    held, placing = sample[: len(sample) // HOLD_OUT], sample[len(sample) // HOLD_OUT :]
    centers = centroids_of(placing, max(1, min(len(placing) // 20, round(math.sqrt(n)))))
    probes = probes_for(held, centers, top)

    def assign(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), dims) @ turn
                near = nearest_lists(x, centers, k)
                away = np.sqrt(((x[:, None, :] - centers[near]) ** 2).sum(2)) if k == 1 else np.stack([np.sqrt(((y - centers[m]) ** 2).sum(1)) for y, m in zip(x, near, strict=True)]) if len(x) else np.zeros((0, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(x))), pa.array(away.ravel())], names=["id", "list", "turn", "away"])

        return run

    shape_of_list = "id long, list int, turn int, away double"
    queries = C.materialize(classes_of_queries(rows, is_query, id_column), "queries")
    of_class = classes.select("class", "x").mapInArrow(assign(1), shape_of_list).select(F.col("id").alias("class"), "list", "away")
    indexed = C.materialize(classes.join(of_class, "class"), "index")
    about = indexed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.max("away").alias("radius"))
    probed = C.materialize(queries.mapInArrow(assign(probes), shape_of_list).join(about, "list"), "probed")
    left = indexed.join(about.select("list", "parts"), "list").select("list", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), "class", "x")

    def wave(visits: DataFrame) -> DataFrame:
        """(id, class, score) that scans of (id, list, parts, best) leave, best a bound on the distance or null."""
        many = visits.groupBy("list").agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("groups"))
        vectors = left.join(many, "list").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        asked = visits.join(many, "list").join(queries, "id").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("group"), "id", "x", "best")
        keys = ["list", "part", "group"]
        return vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "id long, class long, score double")

    def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"id": [], "class": [], "score": []})
        v, q = v.sort_values("class"), q.sort_values("id")
        xs, qs = _matrix(v["x"], dims), _matrix(q["x"], dims)
        # Rotation rounds: the carried bound is widened by far more than that.
        a, b = scan(qs @ turn, xs @ turn, top + 1, (q["best"].fillna(np.inf).to_numpy() * (1 + 1e-9)) ** 2)
        score = np.sqrt(((xs[b] - qs[a]) ** 2).sum(1))
        # A part's best classes of each query are all that its result can need, equal distances included.
        order = np.lexsort((score, a))
        a, b, score = a[order], b[order], score[order]
        begin = np.searchsorted(a, a)
        last = np.minimum(begin + top, np.searchsorted(a, a, "right") - 1)
        keep = score <= score[last] if len(score) else np.zeros(0, bool)
        return pd.DataFrame({"id": q["id"].to_numpy()[a[keep]], "class": v["class"].to_numpy()[b[keep]], "score": score[keep]})

    near = C.materialize(wave(probed.where(F.col("turn") < FIRST).withColumn("best", F.lit(None).cast("double"))), "near")
    nth = near.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("score"))).where(F.col("place") == top + 1).select("id", F.col("score").alias("best"))
    rest = probed.where(F.col("turn") >= FIRST).join(nth, "id", "left").where(F.col("best").isNull() | (F.col("away") - F.col("radius") <= F.col("best") * (1 + 1e-9)))
    found = near.unionByName(wave(rest))
    full = found.join(indexed.select("class", "ids"), "class").select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("query_id != vec_id")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def classes_of_queries(rows: DataFrame, is_query: Column, id_column: str) -> DataFrame:
    """(id, x) of the rows that are queries, each once."""
    return rows.withColumnRenamed("id", id_column).where(is_query).withColumnRenamed(id_column, "id").select("id", "x").dropDuplicates(["id"])


def op2_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op2_ann": op2_ann}
