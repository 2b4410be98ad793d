"""Expressions on sequence columns: validity, composition, descriptors, distances and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residues in the order that defines composition indices.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
# Kyte-Doolittle hydropathy.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
# Average masses of free residues, and of the water lost by a bond.
MASS = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153
# pK of side chains and ends.
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_END = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_C_END = {"D": 4.55, "E": 4.75}


def valid(s: Column) -> Column:
    """Not null, not empty, and of residues only."""
    return F.coalesce(s.rlike(f"^[{RESIDUES}]+$"), F.lit(False))


# Letters that are folded to upper case.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def residues_of(s: Column) -> Column:
    """The residue letters of s, in upper case; null is empty."""
    return F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), LOWER, UPPER), f"[^{RESIDUES}]", "")


def word_list(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def count_of(s: Column, what: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))


def composition(s: Column) -> Column:
    """Share of each residue, in RESIDUES' order; zeros for an empty sequence."""
    return F.array(*(count_of(s, r) / F.greatest(F.length(s), F.lit(1)) for r in RESIDUES))


def bigrams(s: Column) -> Column:
    """Overlapping pairs of characters."""
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def pair_composition(s: Column) -> Column:
    """Share of each of the 400 ordered residue pairs among overlapping pairs; zeros if shorter than two."""
    pairs = F.array(*(F.lit(a + b) for a in RESIDUES for b in RESIDUES))
    own = bigrams(s)
    return F.transform(F.array(own), lambda g: F.transform(pairs, lambda p: F.size(F.filter(g, lambda x: x == p)) / F.greatest(F.size(g), F.lit(1))))[0]


def _weighted(s: Column, weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for r, w in weights.items():
        total = total + count_of(s, r) * w
    return total


def gravy(s: Column) -> Column:
    return F.try_divide(_weighted(s, HYDROPATHY), F.length(s))


def molecular_weight(s: Column) -> Column:
    return F.when(F.length(s) > 0, _weighted(s, MASS) - (F.length(s) - 1) * WATER)


def _end(residue: Column, special: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for r, v in special.items():
        out = F.when(residue == r, v).otherwise(out)
    return out


def charge(s: Column, ph: float = 7.0) -> Column:
    """Net charge by the Henderson-Hasselbalch equation."""
    plus = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
    minus = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
    total = plus(_end(F.substring(s, 1, 1), PK_N_END, 7.5)) - minus(_end(F.substring(s, -1, 1), PK_C_END, 3.55))
    for r, pk in PK_POSITIVE.items():
        total = total + count_of(s, r) * plus(F.lit(pk))
    for r, pk in PK_NEGATIVE.items():
        total = total - count_of(s, r) * minus(F.lit(pk))
    return F.when(F.length(s) > 0, total)


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ; null for other lengths."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"])))


def logit(p: Column, edge: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.ln(c / (1 - c))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5 of the parts joined by a bar."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols))), 1, 8), 16, 10).cast("long") / float(1 << 32)


def sequence_list_hash(sequences: Column, digits: int = 16) -> Column:
    """First digits of SHA-256 over the sequences, each ended by a zero byte."""
    return F.substring(F.sha2(F.concat(F.array_join(sequences, "\0"), F.when(F.size(sequences) > 0, "\0").otherwise("")), 256), 1, digits)


def stable_seed(seed: Column | str | int, *parts: Column | str) -> Column:
    """A seed for every value of parts: four bytes, the least first, of SHA-256 of seed and parts between zero bytes."""
    cols = [F.lit(seed) if isinstance(seed, int) else seed, *(F.col(p) if isinstance(p, str) else p for p in parts)]
    h = F.sha2(F.concat_ws("\0", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cols)), 256)
    return F.conv(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")


def permutations(s: Column) -> Column:
    """Distinct orders of the residues of s other than s itself, exactly; null above 20 residues, for log_permutations()."""
    n = F.length(s)
    total = F.factorial(F.least(n, F.lit(20)))
    for r in RESIDUES:
        total = F.call_function("div", total, F.factorial(F.least(count_of(s, r), F.lit(20))))
    return F.when(n <= 20, total - 1)


def log_factorial(n: Column) -> Column:
    """Decimal logarithm of n! as a sum of logarithms."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda t, k: t + F.log10(k))


def log_permutations(s: Column) -> Column:
    """Decimal logarithm of the distinct orders of the residues of s, itself included, at any length."""
    total = log_factorial(F.length(s))
    for r in RESIDUES:
        total = total - log_factorial(count_of(s, r))
    return total
