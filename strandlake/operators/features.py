"""Feature vectors of sequences by grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import RESIDUES, composition

PAIRS = [a + b for a in RESIDUES for b in RESIDUES]


def handcrafted(rows: DataFrame, key: str = "row_idx", sequence: str = "sequence") -> DataFrame:
    """rows with length, aac and dpc: the sequence's length, shares of 20 residues and of the 400 ordered pairs.

    Together they are the 421-wide vector.  Pairs are counted by grouping, so a sequence's length costs no more than its
    pairs.  Null and empty sequences have zeros, as have pairs of one residue.  key is unique; columns length, aac and dpc of rows are replaced.
    """
    rows = rows.drop("length", "aac", "dpc")
    s = F.coalesce(F.col(sequence), F.lit(""))
    letters = F.split(s, "")
    pairs = F.zip_with(letters, F.slice(letters, 2, 1 << 30), lambda a, b: F.concat(a, b))  # the last has no second: null
    counts = rows.select(key, F.explode(pairs).alias("_pair")).where("_pair IS NOT NULL").groupBy(key, "_pair").agg(F.count("*").alias("_n"))
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_pair", "_n"))).alias("_m"), F.sum("_n").alias("_t"))  # 400 entries and strangers' pairs
    share = F.transform(F.array(*map(F.lit, PAIRS)), lambda p: F.coalesce(F.try_element_at("_m", p) / F.col("_t"), F.lit(0.0)))
    return rows.join(maps, key, "left").withColumns({"length": F.length(s).cast("double"), "aac": composition(s), "dpc": share}).drop("_m", "_t")


def vector(length: str = "length", aac: str = "aac", dpc: str = "dpc"):
    """The 421-wide array: residues, pairs, length."""
    return F.concat(aac, dpc, F.array(length))
