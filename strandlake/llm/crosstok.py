"""Alignment of two tokenizers' tokens: divide and conquer at byte offsets where tokens of both end.

A text's tokens of A and B cover the same bytes.  An interval between two shared ends is cut at the shared end nearest
to its middle, found by bisecting B's ends; both halves follow, and an interval without a shared end inside is a leaf,
a group of A's and B's tokens.  All intervals of a block of texts are cut side by side in NumPy.

Two tokens are linked if they share a group.  Spark counts in how many documents each pair of ids is linked; the most
frequent pairs, ONE_READ at most, are then looked up in a broadcast of bounded size, and others are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .bpe import Codec, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Pairs of ids whose counts are broadcast, 16 bytes each.
ONE_READ = 2_000_000
#: Links of a group that are listed one by one; larger groups are summed by distinct ids first.
LISTED = 256
_SHIFT = 32


class Tokenizers:
    """Both tokenizers of a worker, their tokens' bytes and decimal ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        codec = Codec(a_path)
        special = {*codec.special.values()}
        # Ranks are ids: every merge's token has a greater id than those before it; special tokens are plain text.
        ranks = {x: k for k, x in enumerate(codec.bytes_of) if k not in special and x}
        made = [codec.made[pair] for pair in codec.rank]
        if sorted(made) != made:
            raise ValueError("ids of the vocabulary do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self._exact, self.a_path = None, a_path
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(k) for k in range(size)]
        b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.flat, self.start, self.length = zip(*(self._table(x) for x in (codec.bytes_of, b_bytes)), strict=True)
        # Decimal ids with what follows them inside a group and at its end, A's before B's.
        n = len(codec.bytes_of)
        self.spelt = [f"{k}{after}" for after in ",|" for k in range(n)] + [f"{k}{after}" for after in ",;" for k in range(size)]
        self.offsets = (0, n, 2 * n, 2 * n + size)

    @staticmethod
    def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(x) for x in tokens], np.int64)
        return np.frombuffer(b"".join(tokens) or b"\0", np.uint8), np.cumsum(length) - length, length

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except Exception:  # the pattern's engine gives up on some very long runs; the other library does not
            if self._exact is None:
                from tokenizers import Tokenizer

                self._exact = Tokenizer.from_file(self.a_path)
                self._exact.encode_special_tokens = True
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]

    def covers(self, side: int, ids: np.ndarray, data: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Whether each document's tokens, as long as its bytes in all, spell its bytes."""
        length = self.length[side][ids]
        start = np.cumsum(length) - length
        same = self.flat[side][np.arange(len(data)) + np.repeat(self.start[side][ids] - start, length)] == data
        return np.bincount(doc[~same], minlength=docs) == 0


def shared_ends(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the ends a are cuts, for intervals of tokens lo to hi - 1 whose last ends are shared.

    Each round takes all intervals together: probes go out from the middle, one to the left and one to the right,
    until one finds its end among b by bisection; the halves are the next round's intervals.
    """
    cut = np.zeros(len(a), bool)
    cut[hi - 1] = True
    while True:
        wide = hi - lo > 1
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return cut
        middle, found, left, away = (lo + hi - 2) // 2, np.full(len(lo), -1, np.int64), np.arange(len(lo)), 0
        while len(left):
            at = middle[left] + away
            inside = (at >= lo[left]) & (at <= hi[left] - 2)
            ends = a[np.where(inside, at, 0)]
            hit = inside & (b[np.minimum(np.searchsorted(b, ends), len(b) - 1)] == ends)
            found[left[hit]] = at[hit]
            away = -away if away > 0 else 1 - away
            reach = abs(away)
            left = left[~hit & ((middle[left] + reach <= hi[left] - 2) | (middle[left] - reach >= lo[left]))]
        some = found >= 0
        cut[found[some]] = True
        lo, hi = np.concatenate([lo[some], found[some] + 1]), np.concatenate([found[some] + 1, hi[some]])


def _counts(x: np.ndarray, docs: int, weights: np.ndarray) -> np.ndarray:
    """Exact integer sums of weights by document; x ascends."""
    sums = np.concatenate(([0], np.cumsum(weights)))
    edge = np.searchsorted(x, np.arange(docs + 1))
    return sums[edge[1:]] - sums[edge[:-1]]


def _kept(which: np.ndarray, place: list, raw: list, size: np.ndarray, ids: list[list]) -> tuple:
    """Only the texts that which marks."""
    keep = np.flatnonzero(which)
    return [place[k] for k in keep], [raw[k] for k in keep], size[keep], [[x[k] for k in keep] for x in ids]


def align(texts: list[str | None], t: Tokenizers) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every text.

    pairs holds the distinct linked pairs, a's id in the upper 32 bits; times how often each is linked in the text.
    """
    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    out: list[tuple] = [none] * len(texts)
    place = [k for k, x in enumerate(texts) if x]
    raw = [(" " + texts[k]).encode() for k in place]
    ids = [[t.encode_a(" " + texts[k]) for k in place], t.encode_b([texts[k] for k in place])]
    size = np.array([len(x) for x in raw], np.int64)
    place, raw, size, ids = _kept(np.array([all(int(t.length[s][ids[s][k]].sum()) == n for s in (0, 1)) for k, n in enumerate(size)], bool), place, raw, size, ids)
    if place:  # of texts with as many bytes as their tokens, those with the same bytes
        data, doc = np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.arange(len(raw)), size)
        same = [t.covers(s, np.concatenate(ids[s]), data, doc, len(raw)) for s in (0, 1)]
        place, raw, size, ids = _kept(same[0] & same[1], place, raw, size, ids)
    if not place:
        return out
    a, b = (np.concatenate(x) for x in ids)
    n_a, n_b = (np.array([len(y) for y in x], np.int64) for x in ids)
    docs = len(place)
    end_a, end_b = np.cumsum(t.length[0][a]), np.cumsum(t.length[1][b])
    last = np.cumsum(n_a)
    cut = shared_ends(end_a, end_b, last - n_a, last)
    to_a = np.flatnonzero(cut) + 1
    to_b = np.searchsorted(end_b, end_a[to_a - 1]) + 1
    from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
    wide_a, wide_b = to_a - from_a, to_b - from_b
    doc = np.searchsorted(last, from_a, "right")
    links = wide_a * wide_b
    n_groups, n_links = np.bincount(doc, minlength=docs), _counts(doc, docs, links)
    spelt = _spelt(t, a, b, to_a, to_b, from_a, from_b, cut)
    edge = np.concatenate(([0], last)) + np.concatenate(([0], np.cumsum(n_b)))
    # Links of ordinary groups one by one; those of long ones by their distinct ids.
    few = links <= LISTED
    m = links[few]
    group = np.repeat(np.arange(len(m)), m)
    k = np.arange(len(group)) - (np.cumsum(m) - m)[group]
    row = k // wide_b[few][group]
    keys = (a[from_a[few][group] + row] << _SHIFT) | b[from_b[few][group] + k - row * wide_b[few][group]]
    owner = doc[few][group]
    more: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for g in np.flatnonzero(~few):
        x, nx = np.unique(a[from_a[g] : to_a[g]], return_counts=True)
        y, ny = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
        more.setdefault(int(doc[g]), []).append((((x << _SHIFT)[:, None] | y).ravel(), (nx[:, None] * ny).ravel()))
    edges = np.searchsorted(owner, np.arange(docs + 1))
    for d in range(docs):
        pairs, times = np.unique(keys[edges[d] : edges[d + 1]], return_counts=True)
        if d in more:
            every = np.concatenate([pairs, *(x for x, _ in more[d])])
            pairs, at = np.unique(every, return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, np.concatenate([times, *(x for _, x in more[d])]))
            times = total
        digest = hashlib.sha256("".join(spelt[edge[d] : edge[d + 1]])[:-1].encode()).hexdigest()
        out[place[d]] = (int(n_a[d]), int(n_b[d]), int(n_groups[d]), int(n_links[d]), digest, pairs, times)
    return out


def _spelt(t: Tokenizers, a, b, to_a, to_b, from_a, from_b, cut) -> list[str]:
    """Ids with what follows them, group by group, A's before B's."""
    codes = np.empty(len(a) + len(b), np.int64)
    wide_a, wide_b = to_a - from_a, to_b - from_b
    codes[np.arange(len(a)) + np.repeat(from_b, wide_a)] = a + np.where(cut, t.offsets[1], t.offsets[0])
    end = np.zeros(len(b), bool)
    end[to_b - 1] = True
    codes[np.arange(len(b)) + np.repeat(to_a, wide_b)] = b + np.where(end, t.offsets[3], t.offsets[2])
    return [*map(t.spelt.__getitem__, codes.tolist())]


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """This worker's tokenizers, loaded once."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


_ROW = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, text: str = "text", id_column: str = "doc_id", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row of counts, digest and linked pairs for each row of docs; texts are aligned in blocks of about 1 MB."""
    a_path, b_path = a_path or vocabulary_path(), b_path or vocabulary_path(PIECES)
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        for batch in batches:
            for lo, hi, _, _ in C.chunks(batch.column(1)):
                got = align(batch.column(1).slice(lo, hi - lo).to_pylist(), t)
                n_a, n_b, groups, links, digests, pairs, times = zip(*got, strict=True)
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in pairs]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(x))) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)), pa.array(digests, pa.string()), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_column).cast("long"), text).mapInArrow(run, _ROW)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_counts(docs: DataFrame, text: str = "text", id_column: str = "doc_id", a_path: str | None = None, b_path: str | None = None, one_read: int = ONE_READ) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    Null and empty texts, and texts whose tokens of A or B do not spell a space and the text, have zeros and an empty
    digest, and no part in the counts.  Each row counts as a document, rows that repeat an id too; a null id stays null.  n_best
    counts the links whose pair has its A id's highest count, ties included; count_sum adds up the counts of all links.
    """
    spark = docs.sparkSession
    rows = C.materialize(aligned(docs, text, id_column, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = C.materialize(pair_counts(rows), "pairs", "zstd")
    token = F.shiftright("pair", _SHIFT)
    best = counts.groupBy(token.alias("a")).agg(F.max("n").alias("best"))  # a row to an id of A: bounded by its vocabulary
    counts = counts.join(F.broadcast(best), token == F.col("a")).select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    least = _least(counts, one_read)
    head = counts.where(F.col("n") >= least).toArrow()  # one_read rows at most
    order = np.argsort(head.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(head.column(c).to_numpy()[order]) for c in ("pair", "n", "is_best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, is_best = known.value
        for b in batches:
            lists = b.column("pairs")
            keys, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
            here = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            owner = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy())
            value = np.where(here, n[at], 0) * times if len(pair) else np.zeros(len(keys), np.int64)
            top = np.where(here & is_best[at], times, 0) if len(pair) else value
            rest = np.flatnonzero(~here)
            bounds = np.searchsorted(owner[rest], np.arange(len(b) + 1)).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[rest])) for x in (keys, times)]
            sums = [pa.array(_counts(owner, len(b), x)) for x in (top, value)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:6]), *sums, b.column("_row"), *left], names=[*names[:6], "n_best", "count_sum", "_row", "pairs", "times"])

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, _row long, pairs array<long>, times array<long>"
    out = rows.mapInArrow(run, kinds)
    final = [*names[:5], "n_best", "count_sum", "groups_sha256"]
    if not least:
        return out.select(*final)
    out = C.materialize(out, "looked-up", "zstd")
    asked = out.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = asked.join(counts.where(F.col("n") < least), "pair").groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.join(rest, "_row", "left").withColumns({"n_best": F.col("n_best") + zero("_best"), "count_sum": F.col("count_sum") + zero("_sum")}).select(*final)


def _least(counts: DataFrame, most: int) -> int:
    """0 if all counts are to be broadcast, else the least power of two that at most `most` pairs reach."""
    from .linededup import frequent

    return 0 if counts.count() <= most else frequent(counts, most)


def op13_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


SQL: dict[str, str] = {}
QUERIES = {"op13_cross_tokenizer": op13_cross_tokenizer}
