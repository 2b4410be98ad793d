"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document is the set of its distinct five-word shingles.  The sketch splits the hash space into REGISTERS buckets and
keeps of each bucket's least hash its leading-zero count and MANTISSA bits; an empty bucket takes the register of
the first filled bucket in a fixed random order of its own, so registers agree with probability near the Jaccard
similarity for sets of any size.  Registers are written once: bands of them group documents, and pairs that share a
band are first judged by the registers' estimate, corrected for chance collisions of compressed registers.  Only
pairs that the estimate leaves meet their full sets, on which every link is confirmed.

At similarity 0.75 a pair misses all 80 bands of 6 registers with probability 2e-7.

Documents of equal sets are one class before sketching, so copies make no pairs.  In a band group each member is
compared with a hub, the one that meets most others first; members that verified links join already are not compared
again.  What is left open after HUB_ROUNDS is compared across components: small groups pair by pair, large ones in
blocks of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 80, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Rounds with one hub to each group before the rest is compared across components.
HUB_ROUNDS = 2
#: Open groups of more members are compared in blocks of so many documents and shingles, smaller ones pair by pair.
SMALL_GROUP, BLOCK, BLOCK_ITEMS = 32, 256, 1 << 21
#: Registers whose binomial error an estimate has at least: measured over sets of 5 to 3,000 shingles.
EFFECTIVE = 300

_U = np.uint64
_rng = np.random.default_rng(0xB0B)
_POSITION = _rng.integers(1, 1 << 63, SHINGLE, dtype=_U) * _U(2) + _U(1)
_ROW = _rng.integers(1, 1 << 63, ROWS, dtype=_U) * _U(2) + _U(1)
#: For each register the order in which it borrows from others.
_ORDER = np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1).astype(np.int16)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)


def shingle_sets(words: C.Words) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; fewer words than a shingle make one; none without words."""
    h, n = words.hashes, len(words.hashes)
    if n >= SHINGLE:
        windows = np.zeros(n - SHINGLE + 1, _U)
        for k in range(SHINGLE):
            windows += h[k : n - SHINGLE + 1 + k] * _POSITION[k]
        windows = C.mix(windows)
    out = []
    for d, count in enumerate(words.counts):
        a = words.bounds[d]
        if count >= SHINGLE:
            out.append(np.unique(windows[a : a + count - SHINGLE + 1]))
        elif count:
            out.append(C.mix(np.array([(h[a : a + count] * _POSITION[:count]).sum() + _U(count)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) registers of non-empty sets: leading zeros and mantissa of the least hash of each bucket."""
    low = np.full((len(sets), REGISTERS), -1, np.int64)
    for row, s in zip(low, sets, strict=True):
        # Sorted fingerprints lie in bucket order by their high halves.
        bucket = ((s >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        row[bucket[first]] = np.minimum.reduceat((s & _U(0xFFFFFFFF)).astype(np.int64), first)
    filled = low >= 0
    exponent = np.frexp(np.maximum(low, 1).astype(np.float64))[1]  # bits of the value
    zeros = 32 - exponent
    mantissa = (np.maximum(low, 1) << (zeros + 1) & 0xFFFFFFFF) >> (32 - MANTISSA)
    registers = np.where(filled, zeros << MANTISSA | mantissa, -1).astype(np.int32)
    _borrow(registers, filled)
    return registers


def _borrow(registers: np.ndarray, filled: np.ndarray) -> None:
    """Fill empty registers, each from the first filled bucket in its own order."""
    d, r = np.nonzero(~filled)
    for k in range(12):
        if not len(d):
            return
        source = _ORDER[r, k].astype(np.int64)
        ok = filled[d, source]
        registers[d[ok], r[ok]] = registers[d[ok], source[ok]]
        d, r = d[~ok], r[~ok]
    for doc in np.unique(d):
        own = r[d == doc]
        have = np.flatnonzero(filled[doc])
        registers[doc, own] = registers[doc, have[np.argmin(_RANK[np.ix_(own, have)], axis=1)]]


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(sets, BANDS) fingerprints of the bands."""
    parts = registers.reshape(-1, BANDS, ROWS).astype(_U) + _U(1)
    return C.mix((parts * _ROW).sum(axis=2, dtype=_U) + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketched pairs: the share of equal registers less what chance makes equal."""
    share = (a == b).mean(axis=1)
    chance = 2.0**-MANTISSA / 3  # two independent minima agree in leading zeros with probability 1/3
    return (share - chance) / (1 - chance)


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, data, offsets in C.chunks(batch.column(1)):
        yield a, b, shingle_sets(C.Words(data, offsets, fold_case=True))


def fingerprint(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(doc_id, n_shingles, fp_hi, fp_lo): the size of each document's set and a 128-bit fingerprint of it."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hi, lo = [], [], []
            for *_, sets in _sets_of(b):
                for s in sets:
                    n.append(len(s))
                    hi.append(int(s.sum(dtype=_U).view(np.int64)))
                    lo.append(int((s * s ^ s >> _U(31)).sum(dtype=_U).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["doc_id", "n_shingles", "fp_hi", "fp_lo"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text).mapInArrow(C.gives_back(run), "doc_id long, n_shingles long, fp_hi long, fp_lo long")


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, size, registers) of every (doc_id, text) whose set is not empty: 15 bits to a register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for a, to, sets in _sets_of(b):
                own = [k for k, s in enumerate(sets) if len(s)]
                if own:
                    registers = sketches([sets[k] for k in own]).astype("<i2")
                    yield pa.RecordBatch.from_arrays([ids.slice(a, to - a).take(pa.array(own)), pa.array([len(sets[k]) for k in own], pa.int64()), pa.array([r.tobytes() for r in registers], pa.binary())], names=["doc_id", "size", "registers"])

    return docs.mapInArrow(C.gives_back(run), "doc_id long, size long, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, REGISTERS)


def bands(known: DataFrame) -> DataFrame:
    """(key, doc_id) for every band of the registers of sketched()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = band_keys(_registers(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS), pa.int64())], names=["key", "doc_id"])

    return known.select("doc_id", "registers").mapInArrow(C.gives_back(run), "key long, doc_id long")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, size, items): the sorted set of every (doc_id, text) as bytes of 64-bit fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, to, sets in _sets_of(b):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, to - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "size", "items"])

    return docs.mapInArrow(C.gives_back(run), "doc_id long, size long, items binary")


def _of_pairs(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both documents, named a_ and b_; only rows of documents in pairs are shuffled.

    The ids in question are written first: few are broadcast by their size on disk, many joined by shuffling.
    """
    ids = C.materialize(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "pair-ids")
    rows = rows.join(ids, "doc_id", "left_semi")
    side = lambda k, p: rows.select(F.col("doc_id").alias(k), *(F.col(c).alias(p + c) for c in columns))
    return pairs.join(side("u", "a_"), "u").join(side("v", "b_"), "v")


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those (u, v) that sizes and registers do not rule out: the estimate lies within six standard errors of the bound."""
    bound = percent / 100
    least = bound - 6 * (bound * (1 - bound) / EFFECTIVE) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = (b.column(c).to_numpy() for c in ("a_size", "b_size"))
            keep = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
            keep &= estimate(_registers(b.column("a_registers")), _registers(b.column("b_registers"))) >= least
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep))

    return _of_pairs(pairs, known, ["size", "registers"]).mapInArrow(C.gives_back(run), "u long, v long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (u, v) with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("a_items"), batch.column("b_items"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep))

    return _of_pairs(pairs, sets, ["items"]).mapInArrow(C.gives_back(run), "u long, v long")


def between_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) linked on full sets, of (cluster, doc_id, component) rows, where the components differ.

    A cluster's largest component is never compared with itself.  All others meet it and each other in blocks of
    about BLOCK documents and BLOCK_ITEMS shingles at most, a task to each pair of blocks; a task emits confirmed
    links only.
    """
    members = members.join(sets.select("doc_id", "size"), "doc_id")
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("size").alias("items"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component", "items")).alias("top"), F.sum("n").alias("all"), F.sum("items").alias("all_items"))
    blocks = lambda n, items: F.ceil(F.greatest(n / BLOCK, items / BLOCK_ITEMS)).cast("int")
    others = blocks(F.col("all") - F.col("top.n"), F.col("all_items") - F.col("top.items"))
    main = main.select("cluster", F.col("top.component").alias("main"), blocks(F.col("top.n"), F.col("top.items")).alias("bm"), others.alias("bo")).where("bo > 0")
    placed = members.join(main, "cluster").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("component") == F.col("main"), F.col("bm")).otherwise(F.col("bo"))).cast("int"))
    others = "transform(sequence(0, bo - 1), k -> struct(0 AS kind, least(own, k) AS i, greatest(own, k) AS j))"
    with_main = "transform(sequence(0, bm - 1), k -> struct(1 AS kind, own AS i, k AS j))"
    from_main = "transform(sequence(0, bo - 1), k -> struct(1 AS kind, k AS i, own AS j))"
    dealt = placed.select("cluster", "doc_id", "component", F.explode(F.expr(f"CASE WHEN component = main THEN {from_main} ELSE concat({others}, {with_main}) END")).alias("p")).select("cluster", "p.*", "doc_id", "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        ids, parts = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy()
        own = [np.frombuffer(x, _U) for x in pdf["items"]]
        size = np.array([len(x) for x in own])
        items, column = np.unique(np.concatenate(own), return_inverse=True)
        row = np.repeat(np.arange(len(own)), size)
        often = np.bincount(column, minlength=len(items)) > 1
        number = np.cumsum(often) - 1
        row, column = row[often[column]], number[column[often[column]]]
        both = np.zeros((len(own), len(own)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, int(often.sum()), 8192):  # shared items, so many columns at a time
            x, z = np.searchsorted(column, [a, a + 8192])
            m = np.zeros((len(own), 8192), np.float32)
            m[row[x:z], column[x:z] - a] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        ok = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (parts[:, None] != parts[None, :])
        u, v = np.nonzero(np.triu(ok, 1))
        return pd.DataFrame({"u": ids[u], "v": ids[v]})

    return dealt.join(sets.select("doc_id", "items"), "doc_id").groupBy("cluster", "kind", "i", "j").applyInPandas(run, "u long, v long").distinct()


def keyed(docs: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, int | None]:
    """(docs with _key, the greatest id): a key of each row's own that orders like the ids.

    Where no id is null or repeated, it is the id, and None is returned for the greatest.  Else docs are written with a
    number to each row: the first row of an id keeps the id, repeats and null ids get keys above all ids.
    """
    own = docs.select(F.col(id_column).cast("long").alias("_key"))
    if own.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1 OR _key IS NULL").isEmpty():
        return docs.withColumn("_key", F.col(id_column).cast("long")), None
    rows = C.materialize(docs.withColumns({"_id": F.col(id_column).cast("long"), "_at": F.monotonically_increasing_id()}), "rows")
    top = rows.agg(F.max("_id")).first()[0]
    top = -1 if top is None else top
    first = rows.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_at").alias("_at")).withColumn("_first", F.lit(True))
    key = F.when(F.col("_first"), F.col("_id")).otherwise(F.col("_at") + F.lit(top) + 1)
    return C.materialize(rows.join(first, ["_id", "_at"], "left").select(*docs.columns, key.alias("_key")), "rows"), top


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs, as many rows as docs has.

    Words are split on ASCII white space after A-Z is lower-cased; a null text or one without words has the empty
    set and links with nothing.  component_id is the smallest doc_id reachable over links of at least percent.
    Rows are linked and kept one by one: of each component one row is kept, of the smallest doc_id, though others may
    repeat that id or have none.  Where only null ids, or repeats of an id whose first row is elsewhere, are linked, one
    of them is kept and component_id is its own id.  Other columns are not read.
    """
    rows, top = keyed(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")))
    out = linked(rows.select(F.col("_key").alias("doc_id"), "text"), percent=percent)
    if top is None:
        return out
    ids = rows.select("_key", F.col("doc_id").alias("_id"))
    heads = ids.where(F.col("_key") > top).select(F.col("_key").alias("component_id"), F.col("_id").alias("_head"))
    named = out.join(ids, F.col("doc_id") == F.col("_key")).drop("doc_id", "_key").join(heads, "component_id", "left")
    component = F.when(F.col("component_id") > top, F.col("_head")).otherwise(F.col("component_id"))
    return named.select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"), "kept")


def linked(docs: DataFrame, text: str = "text", id_column: str = "doc_id", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for rows whose ids are neither null nor repeated, such as keyed() makes."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = C.materialize(fingerprint(source, "text", "doc_id"), "prints")
    whole = ["n_shingles", "fp_hi", "fp_lo"]
    classes = prints.where("n_shingles > 0").groupBy(*whole).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("members"))
    classes = C.materialize(classes, "classes")
    # Texts of representatives: all but the documents that repeat an earlier set.
    repeated = classes.where("rep != last").drop("last")
    copies = C.join_classes(prints.where("n_shingles > 0"), repeated, whole, prints.count(), "inner").where("doc_id != rep").select("doc_id")
    reps = source.join(C.materialize(copies, "copies"), "doc_id", "left_anti")
    known = C.materialize(sketched(reps), "sketches")
    of_key = W.partitionBy("key")
    made = bands(known).repartition(C.width(known.count() * BANDS, 1_000_000), "key")
    groups = made.withColumn("n", F.count("*").over(of_key)).where("n > 1")
    # How many others a document meets in all its groups: an original meets more than its edited copies do.
    groups = C.materialize(groups.withColumn("met", F.sum("n").over(W.partitionBy("doc_id"))), "bands")
    tasks = C.width(groups.count())
    members = C.materialize(groups.select("doc_id").distinct(), "members")
    sets = C.materialize(full_sets(source.join(members, "doc_id", "left_semi")), "sets")

    links, tried = sets.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).limit(0), None
    of = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for step in range(HUB_ROUNDS + 1):
        # A group of two has been compared in the first round.
        placed = groups if step == 0 else groups.where("n > 2").join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left").coalesce(tasks)
        placed = placed.withColumn("component", F.col("doc_id") if step == 0 else F.coalesce("component", "doc_id"))
        still = placed.withColumn("lo", F.min("component").over(of_key)).withColumn("hi", F.max("component").over(of_key)).where("lo != hi").drop("lo", "hi")
        best = F.struct((-F.col("met")).alias("m") if step in (0, HUB_ROUNDS) else F.xxhash64("doc_id").alias("m"), F.col("doc_id").alias("id"), F.col("component").alias("c"))
        still = still.withColumn("hub", F.min(best).over(of_key))
        if step < HUB_ROUNDS:
            pairs = still.where("component != hub.c").select(F.col("hub.id").alias("u"), F.col("doc_id").alias("v"))
        else:
            large = still.where(F.col("n") > SMALL_GROUP).select(F.col("hub.id").alias("cluster"), "doc_id", "component").distinct()
            links = links.unionByName(C.materialize(between_components(large, sets, percent), "links"))
            small = still.where(F.col("n") <= SMALL_GROUP)
            other = small.select("key", F.col("doc_id").alias("v"), F.col("component").alias("c2"))
            pairs = small.select("key", F.col("doc_id").alias("u"), "component").join(other, "key").where("u < v AND component != c2").select("u", "v")
        pairs = pairs.coalesce(tasks).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = C.materialize(pairs.coalesce(tasks), "pairs")
        if pairs.isEmpty() and step < HUB_ROUNDS:
            if step == 0:
                break
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        left = C.materialize(plausible(pairs, known, percent), "plausible")
        found = C.materialize(confirm(left, sets, percent), "links")
        links = links.unionByName(found)
        if step == HUB_ROUNDS or not found.isEmpty():
            of = C.materialize(connected_components(links).coalesce(tasks), "components")
    # Classes whose component is not their single document's own.
    by_class = classes.join(of.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").where("rep != last OR component != rep")
    by_class = C.materialize(by_class.select(*whole, F.coalesce("component", "rep").alias("component_id"), "members"), "linked")
    out = C.join_classes(prints, by_class, whole, prints.count(), "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op5_minhash": op5_minhash}
