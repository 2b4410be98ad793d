"""Lines that many documents repeat, found by a sharded minimal perfect hash instead of a join of lines.

A line's key is the line without white space at its ends, A-Z in lower case.  Keys long enough are hashed to 128 bits
and counted by document; those of enough documents are dealt to shards, and each shard becomes a minimal perfect hash
with arrays of 64-bit fingerprints, document counts and the last document.  Documents are then read once more and
probe the arrays; no line is shuffled.

The most frequent keys, ONE_READ at most, are probed while documents are read: their shards are a broadcast of bounded
size.  If there are more, the hashes of the lines that those shards do not know go to the remaining shards, sorted
behind the arrays that they probe, and only the numbers of the lines to drop come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .perfect_hash import PerfectHash, build

#: Code points of a key and documents that hold it, at least.
LEAST_LENGTH, LEAST_DOCS = 40, 5
#: Keys whose shards are broadcast: some 28 bytes each.
ONE_READ = 1_000_000
#: Keys of a shard.
SHARD_KEYS = 100_000
_NO_ID = -(1 << 63)
SHARD = "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, last binary"


def keys_of(text: str, least_length: int = LEAST_LENGTH) -> tuple[list[bytes], list[bytes | None]]:
    """(lines, keys) of a text; the key of a line that is too short is None."""
    lines = text.encode().split(b"\n")
    keys = [x.strip().lower() if len(x) >= least_length else None for x in lines]  # bytes: white space and A-Z of ASCII
    for k, x in enumerate(keys):
        if x is not None and len(x) < 4 * least_length and (len(x) < least_length or not x.isascii() and len(x.decode()) < least_length):
            keys[k] = None
    return lines, keys


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) halves of the keys' 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


class Shard:
    """The arrays of a shard: a key's fingerprint, count and last document stand in its slot."""

    def __init__(self, sizes, bits: bytes, fingerprints: bytes, counts: bytes, last: bytes):
        self.hash = PerfectHash(sizes, np.frombuffer(bits, np.uint8))
        self.fingerprints, self.counts, self.last = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u4"), np.frombuffer(last, "<i8")

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is in the shard, the last document of those)."""
        slot = self.hash.slots(h[:, 0], h[:, 1])
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == h[known, 1]
        return known, self.last[slot[known]]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the second half, of which the place within a shard depends little."""
    return (h[:, 1] >> np.uint64(20)) % np.uint64(max(1, shards))


def counted(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, n, last): the hash of every key of at least least_docs rows of docs, its rows, and the largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rows = [], []
            for x in b.column(1):
                own = {k for k in keys_of(x.as_py() or "", least_length)[1] if k is not None}
                found += own
                rows.append(len(own))
            h = hashes(found).view(np.int64)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), ids], names=["h1", "h2", "id"])

    each = docs.select(F.col(id_column).cast("long"), text).mapInArrow(run, "h1 long, h2 long, id long")
    return each.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_docs)


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row of arrays (SHARD) for each shard of keys (h1, h2, n, last)."""
    half = F.shiftrightunsigned("h2", 20)  # 44 bits: never negative
    placed = keys.select((half % shards).cast("int").alias("shard"), "h1", "h2", "n", "last")

    def run(t: pa.Table) -> pa.Table:
        h1, h2 = (t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        sizes, bits = build(h1, h2)
        slot = PerfectHash(sizes, bits).slots(h1, h2)
        prints, counts, last = np.zeros(len(h1), "<u8"), np.zeros(len(h1), "<u4"), np.zeros(len(h1), "<i8")
        prints[slot], counts[slot], last[slot] = h2, np.minimum(t.column("n").to_numpy(), 2**32 - 1), t.column("last").fill_null(_NO_ID).to_numpy()
        one = {"shard": t.column("shard")[0].as_py(), "sizes": sizes, "bits": bits.tobytes(), "fingerprints": prints.tobytes(), "counts": counts.tobytes(), "last": last.tobytes()}
        return pa.Table.from_pylist([one], schema=pa.schema({"shard": pa.int32(), "sizes": pa.list_(pa.int32()), "bits": pa.binary(), "fingerprints": pa.binary(), "counts": pa.binary(), "last": pa.binary()}))

    return placed.groupBy("shard").applyInArrow(run, SHARD)


def frequent(keys: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` keys have that count or more."""
    power = F.floor(F.log2("n")).cast("int")
    total, least = 0, 62
    for r in sorted(keys.groupBy(power.alias("p")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["p"]):  # 63 rows at most
        total += r["k"]
        if total > most:
            break
        least = r["p"]
    return 1 << least


def drop_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, one_read: int = ONE_READ, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs with text of the lines that stay, n_lines before and n_dropped; columns of docs with those names go.

    Lines are parted at \\n; a null or empty text is one empty line and stays as it is.  A line is dropped if its key has at least
    least_length code points and stands in at least least_docs rows, unless this row's id is the largest of those
    rows'.  Each row counts as a document, rows that repeat an id too; a null id is the smallest of all.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    keys = C.materialize(counted(docs, text, id_column, least_length, least_docs), "lines", "zstd")
    n = keys.count()
    least = 0 if n <= one_read else frequent(keys, one_read)
    head = keys.where(F.col("n") >= least)
    shards = max(1, -(-min(n, one_read) // shard_keys))
    arrays = [tuple(r) for r in build_shards(head, shards).collect()]  # one_read keys at most
    known = spark.sparkContext.broadcast({a[0]: a[1:] for a in arrays})

    def look(h: np.ndarray, ids: np.ndarray, opened: dict[int, Shard]) -> tuple[np.ndarray, np.ndarray]:
        """(known, to drop) of hashes that stand in rows of these ids."""
        found, drop = np.zeros(len(h), bool), np.zeros(len(h), bool)
        place = shard_of(h, shards)
        for s, shard in opened.items():
            at = np.flatnonzero(place == s)
            yes, last = shard.probe(h[at])
            found[at[yes]] = True
            drop[at[yes]] = ids[at[yes]] != last
        return found, drop

    rest_of = _rest(docs, keys, least, text, id_column, least_length, look, known, shard_keys) if least else docs.withColumn("_more", F.lit(None).cast("array<int>"))
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    read = rest_of.select(*others, text, F.col(id_column).cast("long").alias("_id"), "_more")
    out_schema = docs.select(*others, text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {s: Shard(*a) for s, a in known.value.items()}
        for b in batches:
            whole, spans, found, rows = [], [], [], []
            for k, x in enumerate(b.column(text)):
                lines, own = keys_of(x.as_py() or "", least_length)
                whole.append(lines)
                for j, key in enumerate(own):
                    if key is not None:
                        found.append(key)
                        rows.append(k)
                        spans.append(j)
            rows, ids = np.array(rows, np.int64), b.column("_id").fill_null(_NO_ID).to_numpy()
            drop = look(hashes(found), ids[rows], opened)[1]
            dropped: dict[int, set[int]] = {}
            for k in np.flatnonzero(drop):
                dropped.setdefault(int(rows[k]), set()).add(spans[k])
            for k, more in enumerate(b.column("_more").to_pylist()):
                if more:
                    dropped.setdefault(k, set()).update(more)
            texts = b.column(text).to_pylist()
            for k, gone in dropped.items():
                texts[k] = b"\n".join([x for j, x in enumerate(whole[k]) if j not in gone]).decode()
            columns = [b.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array([len(x) for x in whole], pa.int64()), pa.array([len(dropped.get(k, ())) for k in range(len(whole))], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, text, "n_lines", "n_dropped"])

    return read.mapInArrow(run, out_schema.add("n_lines", "long").add("n_dropped", "long"))


def _rest(docs: DataFrame, keys: DataFrame, least: int, text: str, id_column: str, least_length: int, look, known, shard_keys: int) -> DataFrame:
    """docs, written, with _more: the numbers of lines that the shards of less frequent keys drop."""
    tail = keys.where(F.col("n") < least)
    shards = max(1, -(-tail.count() // shard_keys))
    rows = C.materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows", "zstd")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {s: Shard(*a) for s, a in known.value.items()}
        for b in batches:
            ids = b.column(1).fill_null(_NO_ID).to_numpy()
            found, rows, spans = [], [], []
            for k, x in enumerate(b.column(2)):
                for j, key in enumerate(keys_of(x.as_py() or "", least_length)[1]):
                    if key is not None:
                        found.append(key)
                        rows.append(k)
                        spans.append(j)
            h, rows = hashes(found), np.array(rows, np.int64)
            to = ~look(h, ids[rows], opened)[0]
            h, at = h[to], rows[to]
            signed = h.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards).astype(np.int32)), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), b.column(0).take(pa.array(at)), pa.array(ids[at]), pa.array(np.array(spans, np.int32)[to])], names=["shard", "h1", "h2", "row", "id", "line"])

    asked = rows.select("_row", F.col(id_column).cast("long"), text).mapInArrow(ask, "shard int, h1 long, h2 long, row long, id long, line int")
    arrays = build_shards(tail, shards)
    both = arrays.unionByName(asked, allowMissingColumns=True).repartition(C.width(shards, 4), "shard").sortWithinPartitions("shard", F.col("bits").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for b in batches:
            place, head = b.column("shard").to_numpy(), b.column("bits").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(head | (np.diff(place, prepend=place[:1] - 1) != 0))
            for lo, hi in zip(cuts, [*cuts[1:], len(place)], strict=True):
                if head[lo]:
                    shard, at = Shard(*(b.column(c)[int(lo)].as_py() for c in ("sizes", "bits", "fingerprints", "counts", "last"))), place[lo]
                    lo += 1
                if lo == hi or at != place[lo]:
                    continue
                part = b.slice(lo, hi - lo)
                h = np.column_stack([part.column(c).to_numpy() for c in ("h1", "h2")]).view(np.uint64)
                yes, last = shard.probe(h)
                gone = np.flatnonzero(yes)[part.column("id").to_numpy()[yes] != last]
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(gone)), part.column("line").take(pa.array(gone))], names=["_row", "line"])

    more = both.mapInArrow(answer, "_row long, line int").groupBy("_row").agg(F.collect_list("line").alias("_more"))  # one document's lines
    return rows.join(more, "_row", "left").drop("_row")


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SQL = f"""WITH l AS (SELECT rn, doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT rn, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
    many AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= {LEAST_LENGTH} GROUP BY k HAVING count(DISTINCT rn) >= {LEAST_DOCS})
    SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (many.k IS NOT NULL AND l.doc_id IS DISTINCT FROM last) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (many.k IS NOT NULL AND l.doc_id IS DISTINCT FROM last)), '')) AS kept_sha256
    FROM l LEFT JOIN many USING (k) GROUP BY rn"""

SQL = {"op12_line_dedup": _SQL}
QUERIES = {"op12_line_dedup": op12_line_dedup}
