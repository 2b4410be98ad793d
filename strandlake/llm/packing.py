"""Packing documents into training windows by lexical retrieval.

A document is its token ids and one separator.  What fills whole windows alone is cut off first; the tails are then
packed: they are dealt into shards by a min-hash of their adjacent id pairs, so that like texts meet, and in each
shard a BM25 inverted index over those pairs returns, for a seed, the unused tails in order of likeness.  They fill
the seed's window greedily; the one that doesn't fit is cut, and its rest stays to be used.  What a shard can't fill
goes on to the next shard of the partition, so a partition leaves at most one window unfilled.

Shards hold a bounded number of tails of less than one window each, whatever the documents' lengths.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .bpe import vocabulary_path

WINDOW = 1024
SEPARATOR = 0
SHARD_TAILS = 1024
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

_U = np.uint64
_KIND = np.full(256, 0, np.uint8)  # others
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[32, *range(9, 14)]] = 3
#: Bytes of texts that the fast pre-tokenizer leaves to the library: apostrophes, separators, all beyond Latin-1 letters.
_HARD = np.zeros(256, bool)
_HARD[[0x27, *range(0x1C, 0x20), 0xC2, *range(0xC4, 0x100)]] = True


class Tokens:
    """Ids of texts: words are cut on bytes and kept by fingerprint; the library encodes each new word once.

    Texts with apostrophes, special tokens or letters beyond Latin-1 go to the library whole.
    """

    SLOTS, POOL = 1 << 21, 1 << 24

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(self.SLOTS, _U), np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int32)
        self.pool, self.end = np.zeros(self.POOL, np.uint16), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint16, int(size.sum()))
        while self.end + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        at = self.end + np.cumsum(size) - size
        self.pool[self.end : self.end + len(flat)] = flat
        self.end += len(flat)
        slot = (hashes & _U(self.SLOTS - 1)).astype(np.int64)
        self.keys[slot], self.at[slot], self.size[slot] = hashes, at, size
        return at, size

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of consecutive texts in UTF-8."""
        n, texts = len(data), len(offsets) - 1
        hard = np.zeros(texts, bool)
        where = np.flatnonzero(_HARD[data])
        multiply = np.flatnonzero((data == 0x97) | (data == 0xB7))  # after C3: signs, not letters
        multiply = multiply[(multiply > 0) & (data[multiply - 1] == 0xC3)]
        raw = data.tobytes()
        found = [k for s in self.special for k in _finds(raw, s)]
        for x in (where, multiply, np.array(found, np.int64)):
            hard[np.searchsorted(offsets[1:], x, "right")] = True
        out: list = [None] * texts
        slow = np.flatnonzero(hard)
        if len(slow):
            for d, e in zip(slow, self.library.encode_batch_fast([raw[offsets[d] : offsets[d + 1]].decode() for d in slow], add_special_tokens=False), strict=True):
                out[d] = np.array(e.ids, np.uint16)
        kind = _KIND[data]
        begin = np.ones(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin |= first[:n]
        space = kind == 3
        last = np.zeros(n, bool)  # of a run of white space that other text of the same document follows
        if n:
            last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
            begin |= last
            begin[np.flatnonzero(last & (data == 32)) + 1] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        doc = np.searchsorted(offsets[1:], starts, "right")
        easy = ~hard[doc]
        starts, ends, doc = starts[easy], ends[easy], doc[easy]
        p, pi = C.powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(C._VALUES[data] * p[:n], out=sums[1:])
        hashes = C.mix((sums[ends] - sums[starts]) * pi[starts])
        if self.end > 4 * self.POOL:
            self._clear()
        slot = (hashes & _U(self.SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        if len(miss):
            new, one, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            words = [raw[a:z].decode() for a, z in zip(starts[miss[one]].tolist(), ends[miss[one]].tolist(), strict=True)]
            a, z = self._learn(new, words)
            at[miss], size[miss] = a[back], z[back]
        total = np.cumsum(size)
        flat = self.pool[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at - (total - size), size)]
        per = np.bincount(doc, size, texts).astype(np.int64)
        stops = np.cumsum(per)
        for d in np.flatnonzero(~hard):
            out[d] = flat[stops[d] - per[d] : stops[d]]
        return out


def _finds(raw: bytes, what: bytes) -> Iterator[int]:
    k = raw.find(what)
    while k >= 0:
        yield k
        k = raw.find(what, k + 1)


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Codes of adjacent ids: the terms of the index."""
    return ids[:-1].astype(np.int64) << 16 | ids[1:]


def cut(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """Whole windows of each document (sequence_id set), and its tail (null sequence_id; ids and routing key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, serial = tokens(path), TaskContext.get().partitionId() << 36
        for b in batches:
            for a, to, data, offsets in C.chunks(b.column(1)):
                rows = []
                for doc_id, ids in zip(b.column(0).slice(a, to - a).to_pylist(), coder.of(data, offsets), strict=True):
                    ids = np.append(ids, np.uint16(SEPARATOR))
                    n = len(ids)
                    whole = n // WINDOW * WINDOW
                    for at in range(0, whole, WINDOW):
                        own = ids[at : at + WINDOW]
                        rows.append((doc_id, at, WINDOW, _crc(own), n, serial, 0, own.astype("<u2").tobytes() if with_ids else None, None))
                        serial += 1
                    if n > whole:
                        own = ids[whole:]
                        terms = C.mix(pairs_of(own).astype(_U))
                        rows.append((doc_id, whole, n - whole, None, n, None, None, own.astype("<u2").tobytes(), int(terms.min() >> _U(1)) if len(terms) else -1))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "key"]
    schema = pa.schema([(k, pa.binary() if k == "ids" else pa.int64()) for k in names])
    return docs.mapInArrow(C.gives_back(run), PIECE + ", key long")


class Shard:
    """Tails of one shard and the BM25 index over their pairs."""

    def __init__(self, tails: list[tuple[int, int, int, np.ndarray]]):
        """tails: (doc_id, start, doc_tokens, ids)."""
        self.tails = tails
        self.at = [0] * len(tails)  # ids used
        self.free = np.ones(len(tails), bool)
        n = len(tails)
        own = [pairs_of(t[3]) for t in tails]
        sizes = np.array([len(x) for x in own], np.int64)
        codes = np.concatenate([np.zeros(0, np.int64), *own])
        term, which = np.unique(codes, return_inverse=True)
        posting, tf = np.unique(which * n + np.repeat(np.arange(n), sizes), return_counts=True)
        self.term, self.doc = posting // n, posting % n
        df = np.bincount(self.term, minlength=len(term))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if n else 1.0))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.first = np.concatenate(([0], np.cumsum(df)))
        order = np.argsort(self.doc, kind="stable")
        self.terms_of = self.term[order]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(self.doc, minlength=n))))

    def like(self, seed: int) -> np.ndarray:
        """Unused tails, most like the seed first; among equals the nearest in routing order, then the earlier."""
        t = self.terms_of[self.bounds[seed] : self.bounds[seed + 1]]
        size = self.first[t + 1] - self.first[t]
        total = np.cumsum(size)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.first[t] - (total - size), size)
        scores = np.bincount(self.doc[at], self.weight[at], len(self.tails))
        free = np.flatnonzero(self.free)
        return free[np.lexsort((free, np.abs(free - seed), -scores[free]))]

    def pack(self, serial: int, last: bool) -> tuple[list[tuple], list[tuple], int]:
        """Pieces of filled windows, the tails left (none if last), and the next serial number."""
        pieces: list[tuple] = []
        rest = sum(len(t[3]) for t in self.tails)
        seed = 0
        while rest and (rest >= WINDOW or last):
            while not self.free[seed]:
                seed += 1
            filled, found, k = 0, np.array([seed]), 0
            while filled < WINDOW and rest:
                if k == len(found):
                    found, k = self.like(seed), 0
                d = int(found[k])
                k += 1
                doc_id, start, size, ids = self.tails[d]
                a = self.at[d]
                own = ids[a : a + WINDOW - filled]
                pieces.append((doc_id, start + a, len(own), _crc(own), size, serial, filled, own))
                filled += len(own)
                rest -= len(own)
                self.at[d] = a + len(own)
                self.free[d] = self.at[d] < len(ids)
            serial += 1
        left = [(t[0], t[1] + self.at[d], t[2], t[3][self.at[d] :]) for d, t in enumerate(self.tails) if self.free[d]]
        return pieces, left, serial


def pack(docs: DataFrame, text: str = "text", id_column: str = "doc_id", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document: PIECE; ids (little-endian 16-bit) only if with_ids.

    A null or empty text is its separator alone.  Documents are cut at window ends only; pieces of a sequence stand
    gapless from offset 0.  Rows that repeat a document are packed as often as they occur; other columns are not read.
    """
    path = path or vocabulary_path()
    C.small_batches(docs.sparkSession)
    cuts = C.materialize(cut(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")), path, with_ids), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, tails = 1 << 62 | TaskContext.get().partitionId() << 36, []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal tails, serial
            pieces, tails, serial = Shard(tails).pack(serial, last)
            columns = list(zip(*pieces, strict=True)) if pieces else [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:7]] + [pa.array([i.astype("<u2").tobytes() if with_ids else None for i in columns[7]], pa.binary())], names=[x.split()[0] for x in PIECE.split(", ")])

        for b in batches:
            for doc_id, start, size, ids in zip(*(b.column(k).to_pylist() for k in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                tails.append((doc_id, start, size, np.frombuffer(ids, "<u2")))
                if len(tails) >= SHARD_TAILS:
                    yield flush(False)
        if tails:
            yield flush(True)

    dealt = cuts.where("sequence_id IS NULL").select("doc_id", "start", "doc_tokens", "ids", "key").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "start")
    names = [x.split()[0] for x in PIECE.split(", ")]
    return cuts.where("sequence_id IS NOT NULL").select(names).unionByName(dealt.mapInArrow(C.gives_back(run), PIECE))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")


SQL: dict[str, str] = {}
QUERIES = {"op3_packing": op3_packing}
