"""Substring joins by an index of selected q-grams.

A text's selected grams are the least hashes of all windows of consecutive q-grams (winnowing).  A window of a needle
is a window of every text that holds the needle, so what is selected in the needle is selected in the text.  Each
needle is joined on that one of its selected grams which fewest texts have, and the pairs found are verified; a needle
with a gram that no text has is out at once.  Needles are dealt to tiers by length, the shortest being grams themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import _written

#: (bytes of a gram, grams of a window): needles of at least their sum less one are in the first tier that they reach.
TIERS = ((16, 17), (8, 5), (4, 1), (3, 1), (2, 1), (1, 1))
#: Grams of needles up to this number are broadcast, 8 bytes each, and grams of texts left out where they are made.
ONE_READ = 1_000_000
#: Bytes of texts whose grams are made together; a longer text is cut into overlapping spans.
SPAN = 1 << 20


def reach(tier: int) -> int:
    """Bytes of the shortest needle of a tier."""
    q, w = TIERS[tier]
    return q + w - 1


def tier_of(size: int) -> int:
    return next(k for k in range(len(TIERS)) if size >= reach(k))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def selected(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tier: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): the distinct selected grams of every text of data; texts ascend."""
    q, w = TIERS[tier]
    windows = np.maximum(sizes - reach(tier) + 1, 0)
    if not windows.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(data) - q + 1
        gram = np.zeros(n, np.uint64)
        for k in range(q):
            gram = gram * np.uint64(0x100000001B3) + data[k : n + k] if q > 8 else gram << np.uint64(8) | data[k : n + k]
        gram = _mixed(gram + np.uint64(tier + 1) * np.uint64(0x9E3779B97F4A7C15))
    span = 1
    while 2 * span <= w:  # least of so many grams from each place on
        gram, span = np.minimum(gram[:-span], gram[span:]), 2 * span
    if span < w:
        gram = np.minimum(gram[: len(gram) - (w - span)], gram[w - span :])
    owner = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    gram = gram[at]
    new = np.append(True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1]))  # a gram stays least for many windows
    owner, gram = owner[new], gram[new]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1]))
    return owner[new], gram[new]


def _spans(texts: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, sizes, text of each) of about SPAN bytes; spans of one text overlap."""
    parts, size = [], 0

    def joined():
        sizes = np.array([len(x) for _, x in parts], np.int64)
        return np.frombuffer(b"".join(x for _, x in parts), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([k for k, _ in parts])

    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), SPAN):
            parts.append((k, t[lo : lo + SPAN + overlap]))
            size += len(parts[-1][1])
            if size >= SPAN:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def grams(rows: DataFrame, key: str, text: str, tiers: list[int], own_tier: bool, only=None) -> DataFrame:
    """(key, gram): the distinct selected grams of each text in all tiers, or in its own tier alone.

    only: a broadcast sorted array of the grams to keep.
    """
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py().encode() for x in b.column(1)]
            for tier in tiers:
                mine = [k for k, x in enumerate(texts) if x and tier_of(len(x)) == tier] if own_tier else range(len(texts))
                for data, starts, sizes, of in _spans([texts[k] for k in mine], reach(tier) - 1):
                    owner, gram = selected(data, starts, sizes, tier)
                    if only is not None:
                        known = only.value
                        some = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram if len(known) else np.zeros(len(gram), bool)
                        owner, gram = owner[some], gram[some]
                    at = np.array(mine, np.int64)[of[owner]] if len(owner) else owner
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(gram.view(np.int64))], names=["key", "gram"])

    return rows.select(key, text).mapInArrow(run, f"key {key_type}, gram long").withColumnRenamed("key", key)


def substring_pairs(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "text") -> DataFrame:
    """(digest, needle): the SHA-256 of every distinct text with every distinct needle that occurs in it.

    Both sides may be of any size.  Nulls have no part, on either side; empty needles, which occur everywhere, are left
    out here.  Matching is of characters as they are.  Texts of any length are read whole.
    """
    spark = texts.sparkSession
    t = texts.where(F.col(text).isNotNull()).select(F.unhex(F.sha2(text, 256)).alias("digest"), F.col(text).alias("text"))
    n = _written(needles.where(F.col(needle) != "").select(F.col(needle).alias("needle")).distinct().withColumn("needle_id", F.monotonically_increasing_id()), "needles")
    size = F.octet_length("needle")
    used = n.agg(*(F.max((size >= reach(k)) & (size < (reach(k - 1) if k else 1 << 62))).alias(f"t{k}") for k in range(len(TIERS)))).first()
    tiers = [k for k in range(len(TIERS)) if used[f"t{k}"]]
    own = _written(grams(n, "needle_id", "needle", tiers, True), "needle-grams")
    kinds = own.select("gram").distinct()
    few = kinds.limit(ONE_READ + 1).count() <= ONE_READ
    only = spark.sparkContext.broadcast(np.sort(kinds.toArrow().column(0).to_numpy().view(np.uint64))) if few else None  # ONE_READ grams at most
    held = grams(t, "digest", "text", tiers, False, only)
    held = _written((held if few else held.join(kinds, "gram", "left_semi")).distinct(), "text-grams")
    met = held.groupBy("gram").agg(F.count("*").alias("met"))
    # Each needle's gram that fewest texts have; none if a text must lack one of its grams.
    rarest = own.join(met, "gram", "left").groupBy("needle_id").agg(F.min_by("gram", F.struct(F.coalesce("met", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("met", F.lit(0))).alias("met")).where("met > 0")
    pairs = held.join(rarest.select("needle_id", "gram"), "gram").select("digest", "needle_id").join(n, "needle_id").select("digest", "needle")
    return t.join(pairs, "digest").where(F.contains("text", "needle")).select("digest", "needle").distinct()


def contains_any(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "text") -> DataFrame:
    """texts with contained: whether any needle occurs in the text.  Empty needles occur in every text; a null text
    contains nothing.  A column contained of texts is replaced."""
    everywhere = needles.where(F.col(needle) == "").limit(1).count() > 0
    texts = texts.drop("contained")
    if everywhere:
        return texts.withColumn("contained", F.col(text).isNotNull())
    hit = _written(substring_pairs(texts, needles, text, needle).select(F.col("digest").alias("_digest")).distinct(), "contained").withColumn("_hit", F.lit(True))
    return texts.withColumn("_digest", F.unhex(F.sha2(text, 256))).join(hit, "_digest", "left").withColumn("contained", F.coalesce("_hit", F.lit(False))).drop("_digest", "_hit")
