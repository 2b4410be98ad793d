"""Similarity joins of short sequences: lossless candidate bounds in Spark, kernels in Arrow batches.

Candidates are pairs whose lengths and residue counts allow the cutoff.  They come from an equi-join on length
(a length joins only those that its own bound reaches) whose residue counts are compared in the same stage, so no
pair that fails the bound is shuffled.  Sequences are joined once however often they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import RESIDUES, count_of

# BLOSUM62 over RESIDUES' order, upper triangle row by row.
BLOSUM62 = """
4 0 -2 -1 -2 0 -2 -1 -1 -1 -1 -2 -1 -1 -1 1 0 0 -3 -2
9 -3 -4 -2 -3 -3 -1 -3 -1 -1 -3 -3 -3 -3 -1 -1 -1 -2 -2
6 2 -3 -1 -1 -3 -1 -4 -3 1 -1 0 -2 0 -1 -3 -4 -3
5 -3 -2 0 -3 1 -3 -2 0 -1 2 0 0 -1 -2 -3 -2
6 -3 -1 0 -3 0 0 -3 -4 -3 -3 -2 -2 -1 1 3
6 -2 -4 -2 -4 -3 0 -2 -2 -2 0 -2 -3 -2 -3
8 -3 -1 -3 -2 1 -2 0 0 -1 -2 -3 -2 2
4 -3 2 1 -3 -3 -3 -3 -2 -1 3 -3 -1
5 -2 -1 0 -1 1 2 0 -1 -2 -3 -2
4 2 -3 -3 -2 -2 -2 -1 1 -2 -1
5 -2 -2 0 -1 -1 -1 1 -1 -1
6 -2 0 0 1 0 -3 -4 -2
7 -1 -2 -1 -1 -2 -4 -3
5 1 0 -1 -2 -2 -1
5 -1 -1 -3 -3 -2
4 1 -2 -3 -2
5 0 -2 -2
4 -3 -1
11 2
7
"""
_M = np.zeros((20, 20), int)
for _i, _row in enumerate(BLOSUM62.split("\n")[1:-1]):
    for _k, _v in enumerate(map(int, _row.split())):
        _M[_i, _i + _k] = _M[_i + _k, _i] = _v
SCORES = {(a, b): int(_M[i, j]) for i, a in enumerate(RESIDUES) for j, b in enumerate(RESIDUES)}


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 LCS / (|a| + |b|): 100 for equal strings, two empty ones included."""
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def align(a: str, b: str, opening: int = 10, extension: int = 1) -> tuple[int, int, int, float, float]:
    """(score, matches, columns, identity, coverage) of the best local alignment with affine gaps.

    Of maximal cells the first in row order ends it.  The traceback prefers gaps to the diagonal.  identity is matches
    over columns, gaps included; coverage the smaller share of a sequence that the alignment spans.
    """
    n, m = len(a), len(b)
    low = -(10**9)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]  # gap in a: b's residue stands alone
    f = [[low] * (m + 1) for _ in range(n + 1)]  # gap in b
    best, at = 0, (0, 0)
    for i in range(1, n + 1):
        x, hi, hu, ei, fi, fu = a[i - 1], h[i], h[i - 1], e[i], f[i], f[i - 1]
        for j in range(1, m + 1):
            ei[j] = max(hi[j - 1] - opening, ei[j - 1] - extension)
            fi[j] = max(hu[j] - opening, fu[j] - extension)
            s = max(0, hu[j - 1] + SCORES.get((x, b[j - 1]), -4), ei[j], fi[j])
            hi[j] = s
            if s > best:
                best, at = s, (i, j)
    i, j = at
    matches = columns = 0
    state = "h"
    while i > 0 and j > 0:
        if state == "h":
            if h[i][j] == 0:
                break
            if h[i][j] == f[i][j]:
                state = "f"
            elif h[i][j] == e[i][j]:
                state = "e"
            else:
                matches += a[i - 1] == b[j - 1]
                columns += 1
                i, j = i - 1, j - 1
        elif state == "f":
            columns += 1
            state = "h" if f[i][j] == h[i - 1][j] - opening else "f"
            i -= 1
        else:
            columns += 1
            state = "h" if e[i][j] == h[i][j - 1] - opening else "e"
            j -= 1
    if not columns:
        return best, 0, 0, 0.0, 0.0
    return best, matches, columns, matches / columns, min((at[0] - i) / n, (at[1] - j) / m)


#: Pairs whose recurrences run side by side, and the length up to which a subsequence's state fits one word.
SIDE_BY_SIDE, WORD_BITS = 8192, 64
_CODES = np.full(128, 20, np.int8)
_CODES[[ord(c) for c in RESIDUES]] = np.arange(20)
#: Scores by residue code; code 20 is any other character, code 21 padding that no alignment enters.
_TABLE = np.full((22, 22), -4, np.int32)
_TABLE[:20, :20] = _M
_TABLE[21, :] = _TABLE[:, 21] = -1000


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, longest) residue codes and code points, padded, and lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.full((len(texts), max(1, sizes.max(initial=0))), 21, np.int8)
    there, all_points = np.arange(out.shape[1]) < sizes[:, None], np.zeros(out.shape, np.uint32)
    out[there], all_points[there] = _CODES[np.where(points < 128, points, 0)], points
    return out, all_points, sizes


def _by_size(a: list[str], b: list[str]) -> Iterator[np.ndarray]:
    """Positions of pairs, those of like length together, so many at a time."""
    order = np.lexsort(([len(x) for x in b], [len(x) for x in a]))
    for k in range(0, len(order), SIDE_BY_SIDE):
        yield order[k : k + SIDE_BY_SIDE]


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """indel_ratio() of many pairs: the bit-parallel recurrence of all pairs of a batch at once."""
    out = np.empty(len(a))
    for at in _by_size(a, b):
        x, y = [a[k] for k in at], [b[k] for k in at]
        m, n = np.array([len(t) for t in x]), np.array([len(t) for t in y])
        if max(m.max(), n.max()) > WORD_BITS:
            out[at] = [indel_ratio(p, q) for p, q in zip(x, y, strict=True)]
            continue
        points = np.frombuffer("".join(x + y).encode("utf-32-le"), np.uint32)
        kinds, codes = np.unique(points, return_inverse=True)
        place = np.arange(max(1, m.max(), n.max()))
        left, right = np.zeros((len(at), len(place)), np.int64), np.zeros((len(at), len(place)), np.int64)
        left[place < m[:, None]], right[place < n[:, None]] = codes[: m.sum()], codes[m.sum() :]
        where = np.zeros((len(at), max(1, len(kinds))), np.uint64)
        rows = np.arange(len(at))
        for k in range(int(m.max())):
            on = rows[m > k]
            where[on, left[on, k]] |= np.uint64(1 << k)
        state = np.full(len(at), 2**64 - 1, np.uint64)
        for k in range(int(n.max())):
            u = state & where[rows, right[:, k]]
            state = np.where(n > k, (state + u) | (state - u), state)
        low = np.where(m < WORD_BITS, (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
        common = np.bitwise_count(~state & low).astype(float)
        out[at] = np.where(m + n > 0, 200 * common / np.maximum(m + n, 1), 100.0)
    return out


def align_many(a: list[str], b: list[str], opening: int = 10, extension: int = 1) -> pd.DataFrame:
    """align() of many pairs: every cell of the recurrence for all pairs of a batch at once.

    What the traceback would count travels forward with each cell: matches, columns and where the alignment begins.
    """
    out = np.zeros((len(a), 5))
    for at in _by_size(a, b):
        x, px, n = _coded([a[k] for k in at])
        y, py, m = _coded([b[k] for k in at])
        size, low = len(at), -(10**6)
        first = lambda i, j: np.int64(i) << 32 | np.int64(j) << 48
        column, zeros = np.int64(1 << 16), np.zeros(size, np.int32)
        h = [zeros] * (y.shape[1] + 1)
        f = [np.full(size, low, np.int32)] * len(h)
        ch, cf = [np.full(size, first(0, j)) for j in range(len(h))], [np.zeros(size, np.int64)] * len(h)
        best, end, carried = zeros.copy(), np.zeros((2, size), np.int64), np.zeros(size, np.int64)
        for i in range(1, x.shape[1] + 1):
            up, cup = h, ch
            h, ch = [zeros], [np.full(size, first(i, 0))]
            e, ce = np.full(size, low, np.int32), np.zeros(size, np.int64)
            f, cf = [*f], [*cf]
            score = _TABLE[x[:, i - 1]]
            for j in range(1, y.shape[1] + 1):
                opened = h[j - 1] - opening
                ce = np.where(opened >= e - extension, ch[j - 1], ce) + column
                e = np.maximum(opened, e - extension)
                opened = up[j] - opening
                cf[j] = np.where(opened >= f[j] - extension, cup[j], cf[j]) + column
                f[j] = np.maximum(opened, f[j] - extension)
                diagonal = up[j - 1] + score[np.arange(size), y[:, j - 1]]
                now = np.maximum(np.maximum(diagonal, 0), np.maximum(e, f[j]))
                same = (px[:, i - 1] == py[:, j - 1]).astype(np.int64)
                own = np.where(now == f[j], cf[j], np.where(now == e, ce, cup[j - 1] + column + same))
                ch.append(np.where(now == 0, first(i, j), own))
                h.append(now)
                higher = now > best
                best = np.where(higher, now, best)
                carried = np.where(higher, ch[j], carried)
                end[0], end[1] = np.where(higher, i, end[0]), np.where(higher, j, end[1])
        matches, columns, si, sj = carried & 0xFFFF, carried >> 16 & 0xFFFF, carried >> 32 & 0xFFFF, carried >> 48 & 0xFFFF
        some = columns > 0
        cover = np.minimum((end[0] - si) / np.maximum(n, 1), (end[1] - sj) / np.maximum(m, 1))
        out[at] = np.column_stack([best, matches, columns, np.where(some, matches / np.maximum(columns, 1), 0), np.where(some, cover, 0)])
    return pd.DataFrame(out, columns=["score", "matches", "columns", "identity", "coverage"]).astype({"score": "int32", "matches": "int32", "columns": "int32"})


def shared_residues(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of residue counts."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def residue_counts(s: Column) -> Column:
    """Counts of the residues and, last, of all other characters: equal strings share their whole length."""
    own = [count_of(s, r) for r in RESIDUES]
    rest = F.length(s)
    for c in own:
        rest = rest - c
    return F.array(*own, rest)


#: Keys to a length in candidate joins.
SALTS = 8


def candidates(left: DataFrame, right: DataFrame, least_share: float, of: str, self_join: bool) -> DataFrame:
    """(l_idx, l_seq, r_idx, r_seq) of pairs whose length and residue bound reaches the share.

    of is "sum": share * (|a| + |b|) / 2 residues must be common; "max": share * max(|a|, |b|).  Columns row_idx and
    sequence; self_join keeps l_idx < r_idx.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("row_idx").alias(f"{p}_idx"), F.col("sequence").alias(f"{p}_seq"), F.length("sequence").alias(f"{p}_len"), residue_counts(F.col("sequence")).alias(f"{p}_res"))

    l, r = side(left, "l").where("l_len > 0"), side(right, "r").where("r_len > 0")
    reach = least_share / (2 - least_share) if of == "sum" else least_share  # least ratio of the lengths
    slack = 1e-9
    # Few lengths hold most sequences: l is dealt to SALTS keys of each length, and r stands under all of them.
    l = l.withColumn("salt", F.pmod(F.xxhash64("l_idx"), F.lit(SALTS)).cast("int"))
    r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Every length that l can meet; one row of l for each.
    spread = l.withColumn("r_len", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("l_len") * reach - slack).cast("int")), F.floor(F.col("l_len") / reach + slack).cast("int"))))
    need = least_share * (F.col("l_len") + F.col("r_len")) / 2 if of == "sum" else least_share * F.greatest("l_len", "r_len")
    both = spread.join(r, ["r_len", "salt"]).where(shared_residues(F.col("l_res"), F.col("r_res")) >= need - slack)
    return (both.where("l_idx < r_idx") if self_join else both).select("l_idx", "l_seq", "r_idx", "r_seq")


def ratio_join(left: DataFrame, right: DataFrame | None = None, cutoff: float = 60.0) -> DataFrame:
    """(l_idx, r_idx, ratio) with indel_ratio of at least cutoff; a self-join of l_idx < r_idx if right is None."""
    pairs = candidates(left, left if right is None else right, cutoff / 100, "sum", right is None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratio = ratios(b["l_seq"].tolist(), b["r_seq"].tolist())
            yield pd.DataFrame({"l_idx": b["l_idx"], "r_idx": b["r_idx"], "ratio": ratio})[ratio >= cutoff]

    return pairs.mapInPandas(run, "l_idx long, r_idx long, ratio double")


_ALIGNED = "l_idx long, r_idx long, score int, matches int, columns int, identity double, coverage double"


def aligned(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = align_many(b["l_seq"].tolist(), b["r_seq"].tolist())
            out.insert(0, "r_idx", b["r_idx"].to_numpy())
            out.insert(0, "l_idx", b["l_idx"].to_numpy())
            yield out

    return pairs.mapInPandas(run, _ALIGNED)


def alignment_join(rows: DataFrame, identity: float = 0.6, coverage: float = 0.8) -> DataFrame:
    """Alignments of l_idx < r_idx with at least this identity and coverage, with a slack of 1e-12."""
    pairs = candidates(rows, rows, identity * coverage, "max", True)
    return aligned(pairs).where((F.col("identity") + 1e-12 >= identity) & (F.col("coverage") + 1e-12 >= coverage))


#: Queries and rows of the pool of one block, and the pairs of a query that a block aligns in a round.
QUERY_BLOCK, POOL_BLOCK, ROUND = 256, 1024, 16


def _packs(rows: DataFrame, size: int, idx: str, seq: str, pack: str, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(pack, idx and seq arrays) of about size rows each, and the number of packs."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(F.col("row_idx").alias(idx), F.coalesce("sequence", F.lit("")).alias(seq), *more).withColumn(pack, F.pmod(F.xxhash64(idx), F.lit(n)).cast("int"))
    return dealt.groupBy(pack).agg(F.collect_list(F.struct(idx, seq, *more)).alias("_p")).select(pack, *(F.col("_p")[c].alias(c) for c in (idx, seq, *more))), n


def _residues(texts: list[str]) -> np.ndarray:
    """(texts, 21) counts of residue codes; the last is of all other characters."""
    out = np.zeros((len(texts), 21), np.int16)
    for k, t in enumerate(texts):
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        out[k] = np.bincount(_CODES[np.where(points < 128, points, 0)], minlength=21)[:21]
    return out


def bounds(a: list[str], b: list[str]) -> np.ndarray:
    """(a, b) upper bounds of identity times coverage: shared residues over the greater length.

    Matches are at most the shared residues, and columns at least the coverage of the longer sequence.
    """
    x, y = _residues(a), _residues(b)
    shared = np.zeros((len(a), len(b)), np.int32)
    for c in range(x.shape[1]):
        shared += np.minimum(x[:, c, None], y[None, :, c])
    longest = np.maximum(np.array([len(t) for t in a])[:, None], np.array([len(t) for t in b])[None, :])
    return shared / np.maximum(longest, 1)


_BEST = "l_idx long, kind int, product double, identity double, coverage double, score int, r_idx long"
_RANK = ["product", "identity", "coverage", "score"]


def _bests(found: pd.DataFrame, floor: float, identity: float, by_product: bool) -> pd.DataFrame:
    """Of aligned pairs the best of each query: of kind 0 among all, of kind 1 among those of enough coverage and identity."""
    found = found[found["score"] > 0]
    product = found["identity"] * found["coverage"] if by_product else found["identity"]
    enough = (found["coverage"] + 1e-12 >= floor) & (found["identity"] + 1e-12 >= identity)
    parts = [found.assign(product=product, kind=0), found[enough].assign(product=0.0, kind=1)]
    both = pd.concat(parts).sort_values([*_RANK, "r_idx"], ascending=[False] * 4 + [True], kind="stable").drop_duplicates(["l_idx", "kind"])
    return both[["l_idx", "kind", *_RANK, "r_idx"]]


def nearest(queries: DataFrame, pool: DataFrame, floor: float = 0.8, identity: float = 0.0, by_product: bool = False, counted: dict | None = None) -> DataFrame:
    """For every query its best alignment in the pool, the first row winning ties; and its best among those of at least
    floor coverage and identity.

    Best is by (identity, coverage, score); by_product puts identity times coverage before, for the unrestricted one.
    The stated queries meet the pool in blocks of QUERY_BLOCK by POOL_BLOCK rows, where residue counts bound every pair
    (bounds()).  First each block aligns the ROUND pairs of each query with the highest bounds; then, the bests of all
    blocks known, pairs are aligned in the order of their bounds until none that is left can win.  Only bests are
    shuffled.  Queries without alignment keep 0, 0 and null.  counted, if given, gets the numbers of pairs and of alignments.
    """
    from ._arrow import one_row_batches
    from .grouping import _written

    p, parts = _packs(pool, POOL_BLOCK, "r_idx", "r_seq", "_r")
    p = _written(p, "pool")
    spark = queries.sparkSession
    aligned_pairs = spark.sparkContext.accumulator(0)

    def met(q: DataFrame) -> DataFrame:
        return q.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(p, "_r")

    def pairs_of(li, ls, ri, rs, a, b) -> pd.DataFrame:
        got = align_many([ls[k] for k in a], [rs[k] for k in b])
        aligned_pairs.add(len(a))
        return got.assign(l_idx=np.asarray(li)[a], r_idx=np.asarray(ri)[b])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for li, ls, ri, rs in zip(batch["l_idx"], batch["l_seq"], batch["r_idx"], batch["r_seq"], strict=True):
                u = bounds(ls, rs)
                top = np.argsort(-u, axis=1, kind="stable")[:, :ROUND]
                yield _bests(pairs_of(li, ls, ri, rs, np.repeat(np.arange(len(ls)), top.shape[1]), top.ravel()), floor, identity, by_product)

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for li, ls, ri, rs, any_, some in zip(batch["l_idx"], batch["l_seq"], batch["r_idx"], batch["r_seq"], batch["any_"], batch["some_"], strict=True):
                u = bounds(ls, rs)
                order = np.argsort(-u, axis=1, kind="stable")
                # What a pair must reach: any_ is (first rank, coverage) of the best of all, some_ the best identity of the eligible.
                lead = np.array([[x["product"], x["coverage"]] for x in any_], float)
                eligible = np.array([x["identity"] for x in some], float)
                at, open_ = ROUND, np.arange(len(ls))
                while len(open_) and at < order.shape[1]:
                    v = u[open_, order[open_, at]] + 1e-9
                    wins = v >= lead[open_, 0] if by_product else (lead[open_, 0] < 1) | (v >= lead[open_, 1])
                    wins &= v > 1e-9
                    qualifies = (v >= floor * identity) & (np.minimum(1, v / max(floor, 1e-9)) + 1e-9 >= eligible[open_])
                    open_ = open_[wins | qualifies]
                    if not len(open_):
                        break
                    here = order[open_, at : at + ROUND]
                    got = _bests(pairs_of(li, ls, ri, rs, np.repeat(open_, here.shape[1]), here.ravel()), floor, identity, by_product)
                    place = {x: k for k, x in enumerate(li)}
                    for row in got.itertuples(index=False):
                        k = place[row.l_idx]
                        if row.kind == 0 and (row.product, row.coverage if row.product >= 1 else 0) > (lead[k, 0], lead[k, 1] if lead[k, 0] >= 1 else 0):
                            lead[k] = row.product, row.coverage
                        if row.kind == 1:
                            eligible[k] = max(eligible[k], row.identity)
                    yield got
                    at += ROUND

    order = W.partitionBy("l_idx", "kind").orderBy(*(F.desc(c) for c in _RANK), "r_idx")
    best = lambda found: found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    with one_row_batches(spark):
        q, _ = _packs(queries, QUERY_BLOCK, "l_idx", "l_seq", "_q")
        early = _written(best(met(q).select("l_idx", "l_seq", "r_idx", "r_seq").mapInPandas(first, _BEST)), "bests")
        known = lambda kind, name: early.where(F.col("kind") == kind).select(F.col("l_idx").alias("row_idx"), F.struct("product", "identity", "coverage").alias(name))
        none = F.struct(F.lit(-1.0).alias("product"), F.lit(-1.0).alias("identity"), F.lit(-1.0).alias("coverage"))
        led = queries.select("row_idx", "sequence").join(known(0, "any_"), "row_idx", "left").join(known(1, "some_"), "row_idx", "left").withColumns({c: F.coalesce(c, none) for c in ("any_", "some_")})
        q, _ = _packs(led, QUERY_BLOCK, "l_idx", "l_seq", "_q", ("any_", "some_"))
        late = _written(met(q).select("l_idx", "l_seq", "r_idx", "r_seq", "any_", "some_").mapInPandas(rest, _BEST), "later")
    if counted is not None:
        counted |= {"pairs": queries.count() * pool.count(), "aligned": aligned_pairs.value}
    top = best(early.unionByName(late))
    pick = lambda k, p: top.where(F.col("kind") == k).select("l_idx", *(F.col(c).alias(f"{p}{c}") for c in ("identity", "coverage", "score", "r_idx")))
    out = queries.select(F.col("row_idx").alias("l_idx")).join(pick(0, ""), "l_idx", "left").join(pick(1, "eligible_"), "l_idx", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("identity", "coverage", "score", "eligible_identity", "eligible_coverage", "eligible_score")}
    return out.withColumns(zero)


def similarity_removal(train: DataFrame, test: DataFrame, identity: float = 0.6, coverage: float = 0.8) -> DataFrame:
    """(row_idx, nearest_idx, identity, coverage, score, removed) of every row of train.

    A row is removed if a row of test aligns with it with at least this identity and coverage; the nearest is then the
    best of those, else the best of all by identity times coverage.
    """
    n = nearest(train, test, coverage, identity, by_product=True)
    hit = F.col("eligible_r_idx").isNotNull()
    best = lambda c: F.when(hit, F.col(f"eligible_{c}")).otherwise(F.col(c)).alias(c if c != "r_idx" else "nearest_idx")
    return n.select(F.col("l_idx").alias("row_idx"), best("r_idx"), best("identity"), best("coverage"), best("score"), hit.alias("removed"))


def least_edits(m: int, n: int, cutoff: float) -> int:
    """Insertions and deletions that lengths m <= n may be apart with an indel ratio of cutoff; -1 if they can't reach it.

    Their number is even or odd as n - m is.
    """
    k = int((1 - cutoff / 100) * (m + n) + 1e-9)
    k -= (k - (n - m)) % 2
    return k if k >= n - m else -1


def segments(m: int, parts: int) -> list[tuple[int, int]]:
    """(begin, length) of so many even parts of a string of length m, the shorter ones first."""
    base, longer = divmod(m, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


#: Subsequences that key a string for one other length, at most; lengths that need more are keyed by parts.  Keys made at once.
SUBSEQUENCES, KEYS = 256, 1 << 18


@lru_cache(maxsize=128)
def subsequences(size: int, kept: int) -> np.ndarray:
    """(choices, kept) positions of all subsequences of so many letters."""
    return np.array([*combinations(range(size), kept)], np.int64)


def key_positions(m: int, n: int, cutoff: float, as_shorter: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(part, (keys, letters) positions) of the keys under which a string of length m meets all of length n >= m in reach.

    A pair in reach has a common subsequence of m less the deletions that the lengths leave.  Where subsequences of that
    length are few, they are the keys, and only pairs in reach meet.  Else the shorter string is cut into one more part
    than edits are allowed, so one part is whole in the longer one.  Edits before it are at most the deletions, or the
    insertions, which bounds where it may lie.  Where the shorter one has fewer letters than that needs, the pair of
    lengths is the only key.
    """
    k = least_edits(m, n, cutoff)
    if k < 0:
        return
    gone, come = (k - (n - m)) // 2, (k + (n - m)) // 2
    if come in (0, n) or n <= SUBSEQUENCES and comb(n, come) <= SUBSEQUENCES:
        yield 0, subsequences(m if as_shorter else n, m - gone)
    elif k >= m:
        yield 0, subsequences(m if as_shorter else n, 0)
    else:
        for i, (at, length) in enumerate(segments(m, k + 1)):
            begin, end = (at, at) if as_shorter else (max(0, at - gone), min(n - length, at + come))
            yield i, np.arange(begin, end + 1)[:, None] + np.arange(length)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def keyed(points: np.ndarray, cutoff: float, as_shorter: bool, equal: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) under which every pair of at least this ratio meets, of strings of one length as shorter or longer sides.

    points: (strings, length) code points.  A key is 64 bits of both lengths, the part and the letters; a string has each once.
    """
    size, share = points.shape[1], cutoff / 100
    points, weights = points.astype(np.uint64), _mixed(np.arange(size)) | np.uint64(1)
    reach = share / (2 - share)
    others = range(size if equal else size + 1, int(size / reach + 1e-9) + 1) if as_shorter else range(max(1, int(np.ceil(size * reach - 1e-9))), size + equal)
    for other in others:
        m, n = (size, other) if as_shorter else (other, size)
        for part, at in key_positions(m, n, cutoff, as_shorter):
            what = np.zeros(1, np.uint64)
            for x in (m, n, part):
                what = _mixed(what + np.uint64(x))
            step = max(1, KEYS // len(at))
            for k in range(0, len(points), step):
                own = points[k : k + step]
                key = np.repeat(what, len(own) * len(at)).reshape(len(own), len(at))
                for j in range(at.shape[1]):
                    key += own[:, at[:, j]] * weights[j]
                key.sort(axis=1)
                new = np.ones(key.shape, bool)
                new[:, 1:] = key[:, 1:] != key[:, :-1]
                yield np.nonzero(new)[0] + k, key[new].view(np.int64)


def signatures(s: str, cutoff: float, as_shorter: bool, equal: bool = True) -> list[int]:
    """keyed() of one string."""
    points = np.frombuffer(s.encode("utf-32-le"), np.uint32)[None]
    return [int(x) for _, keys in keyed(points, cutoff, as_shorter, equal) for x in keys]


def _signed(rows: DataFrame, p: str, cutoff: float, as_shorter: bool, equal: bool = True) -> DataFrame:
    names = ["key", f"{p}_idx", f"{p}_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.RecordBatch, made: list) -> pa.RecordBatch:
            at, key = (np.concatenate(x) for x in zip(*made, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c).take(pa.array(at)) for c in ("i", "s"))], names)

        for b in batches:
            texts = b.column("s").to_pylist()
            sizes, made, n = np.array([len(t) for t in texts], np.int64), [], 0
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                points = np.frombuffer("".join(texts[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), size)
                for row, key in keyed(points, cutoff, as_shorter, equal):
                    made.append((at[row], key))
                    n += len(key)
                    if n >= KEYS:
                        yield out(b, made)
                        made, n = [], 0
            if made:
                yield out(b, made)

    own = rows.where(F.length("sequence") > 0).select(F.col("row_idx").cast("long").alias("i"), F.col("sequence").alias("s"))
    return own.mapInArrow(run, f"key long, {p}_idx long, {p}_seq string")


def signature_join(left: DataFrame, right: DataFrame | None = None, cutoff: float = 85.0) -> DataFrame:
    """(l_idx, r_idx, ratio) with an indel ratio of at least cutoff, as ratio_join(), by keys that get selective as the cutoff rises.

    Nulls and empty sequences take no part; row_idx is unique.  A self-join of l_idx < r_idx if right is None.
    """
    keep = ["l_idx", "l_seq", "r_idx", "r_seq"]
    pairs = _signed(left, "l", cutoff, True).join(_signed(left if right is None else right, "r", cutoff, False), "key").select(*keep)
    if right is None:
        apart = F.length("l_seq") < F.length("r_seq")
        pairs = pairs.where(apart | (F.col("l_idx") < F.col("r_idx")))
    else:
        pairs = pairs.unionByName(_signed(right, "r", cutoff, True, False).join(_signed(left, "l", cutoff, False, False), "key").select(*keep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratio = ratios(b["l_seq"].tolist(), b["r_seq"].tolist())
            yield pd.DataFrame({"l_idx": b["l_idx"], "r_idx": b["r_idx"], "ratio": ratio})[ratio >= cutoff]

    found = pairs.mapInPandas(run, "l_idx long, r_idx long, ratio double")
    ends = (F.least("l_idx", "r_idx").alias("l_idx"), F.greatest("l_idx", "r_idx").alias("r_idx")) if right is None else ("l_idx", "r_idx")
    return found.select(*ends, "ratio").distinct()
