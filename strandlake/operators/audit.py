"""Dataset summaries, label audits, balance, exact tests and guards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summary(rows: DataFrame, keys: list[str], label: str = "label", length: str = "length") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.avg(length).alias("mean_length"))


def class_table(rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Per value of key: rows of both classes (0 where none), the smaller count, and whether both occur."""
    wide = rows.where(F.col(label).isNotNull()).groupBy(key).pivot(label, [0, 1]).count().na.fill(0)
    wide = wide.select(key, F.col("0").alias("negative"), F.col("1").alias("positive"))
    return wide.withColumn("shared", F.least("negative", "positive")).withColumn("both", F.col("shared") > 0)


def integrity(rows: DataFrame, split: str = "split", sequence: str = "sequence", label: str = "label", row: str = "row_idx") -> DataFrame:
    """rows with duplicate (within a split), conflict (other labels of the sequence), crosses (other splits) and first."""
    same = W.partitionBy(sequence)
    return (
        rows.withColumn("duplicate", F.count("*").over(W.partitionBy(split, sequence)) > 1)
        .withColumn("conflict", F.coalesce(F.min(label).over(same) != F.max(label).over(same), F.lit(False)))
        .withColumn("crosses", F.coalesce(F.min(split).over(same) != F.max(split).over(same), F.lit(False)))
        .withColumn("first", F.row_number().over(same.orderBy(row)) == 1)
    )


def overlaps(rows: DataFrame, split: str = "split", sequence: str = "sequence") -> DataFrame:
    """(left_split, right_split, side, n): of every pair of splits the sequences in both, in the left and in the right only.

    rows are grouped once by sequence; what is paired are the sets of splits that some sequence has.  A null sequence
    is a value like others, rows without split are in none.
    """
    own = rows.where(F.col(split).isNotNull()).select(F.col(split).alias("s"), F.col(sequence).alias("q")).distinct()
    sets = own.groupBy("q").agg(F.array_sort(F.collect_set("s")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    each = sets.select(F.explode("k").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
    l, r = (each.select(F.col("s").alias(f"{x}_split"), F.col("n").alias(f"{x}_n")) for x in ("left", "right"))
    both = sets.select("n", F.explode("k").alias("left_split"), "k").select("n", "left_split", F.explode("k").alias("right_split")).where("left_split < right_split").groupBy("left_split", "right_split").agg(F.sum("n").alias("b"))
    pairs = l.join(r, F.col("left_split") < F.col("right_split")).join(both, ["left_split", "right_split"], "left").na.fill({"b": 0})
    return pairs.select("left_split", "right_split", F.expr("stack(3, 'both', b, 'left', left_n - b, 'right', right_n - b) AS (side, n)"))


def items(one_row: DataFrame) -> DataFrame:
    """(item, value) of the columns of a one-row table, values as text."""
    names = one_row.columns
    return one_row.select(F.expr(f"stack({len(names)}, {', '.join(f'"{n}", CAST(`{n}` AS STRING)' for n in names)}) AS (item, value)"))


def balance(rows: DataFrame, features: list[str], schemes: dict[str, Column], label: str = "label") -> DataFrame:
    """(scheme, feature, positive_mean, negative_mean, smd): weighted means and their standardised difference.

    The variance is of the population; a zero denominator gives 0.
    """
    weights = ", ".join(f"'{s}', `_w{k}`" for k, s in enumerate(schemes))
    values = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    wide = rows.where(F.col(label).isin(0, 1)).withColumns({f"_w{k}": w.cast("double") for k, w in enumerate(schemes.values())})
    long = wide.select(label, *(f"_w{k}" for k in range(len(schemes))), F.expr(f"stack({len(features)}, {values}) AS (feature, x)")).select(label, "feature", "x", F.expr(f"stack({len(schemes)}, {weights}) AS (scheme, w)"))
    g = long.where("x IS NOT NULL AND w IS NOT NULL").groupBy("scheme", "feature", label).agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("x")).alias("s1"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("s2"))
    m = g.withColumn("mean", F.try_divide("s1", "s0")).withColumn("var", F.greatest(F.try_divide("s2", "s0") - F.pow("mean", F.lit(2)), F.lit(0.0)))
    pick = lambda c, v: F.max(F.when(F.col(label) == c, F.col(v)))
    out = m.groupBy("scheme", "feature").agg(pick(1, "mean").alias("positive_mean"), pick(0, "mean").alias("negative_mean"), pick(1, "var").alias("vp"), pick(0, "var").alias("vn"))
    pooled = F.sqrt((F.col("vp") + F.col("vn")) / 2)
    return out.select("scheme", "feature", "positive_mean", "negative_mean", F.coalesce(F.try_divide(F.col("positive_mean") - F.col("negative_mean"), F.nullif(pooled, F.lit(0.0))), F.lit(0.0)).alias("smd"))


def effective_size(w: Column) -> Column:
    return F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w))


def label_manifest(rows: DataFrame, header_label: Column, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """rows (row_idx, split, header, sequence, label, found) with row_id, length and what an audit of labels marks.

    header_label is an expression of header.  found says whether the sequence occurs in some other source.  Marks:
    header_label and whether there is one and it agrees, a valid alphabet, repeats within a split, overlap of splits, and
    other labels of the same sequence.
    """
    out = integrity(rows).withColumns({"row_id": F.format_string("row_%05d", F.col("row_idx")), "length": F.length("sequence"), "header_label": header_label})
    agrees = F.col("header_label").isNull() | F.coalesce(F.col("header_label") == F.col("label"), F.lit(False))
    marks = {"header_label_available": F.col("header_label").isNotNull(), "header_label_consistent": agrees, "valid_alphabet": F.coalesce(F.col("sequence").rlike(f"^[{alphabet}]+$"), F.lit(False))}
    names = {"duplicate": "duplicated_within_split", "crosses": "cross_split_overlap", "conflict": "conflicting_label", "found": "found_elsewhere"}
    return out.withColumns(marks).withColumnsRenamed(names).select("row_id", "row_idx", "split", "header", "sequence", "length", "label", "header_label", *marks, *names.values())


def label_audit_items(manifest: DataFrame, splits: dict[str, object], tested: str, reported: tuple[int, int]) -> DataFrame:
    """(item, value) of a label_manifest(): 21 items, counts in one pass and Fisher's test on four of them.

    splits maps names to values of split; tested is the one whose headers are compared; reported are the positive and
    negative counts published elsewhere.
    """
    y, at = F.col("label"), lambda k: F.col("split") == F.lit(splits[k])
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    found = {}
    for k in splits:
        found |= {f"{k}_n": n(at(k)), f"{k}_positive": n(at(k) & (y == 1)), f"{k}_negative": n(at(k) & (y == 0))}
    found |= {
        "total_n": F.count("*"), "total_positive": n(y == 1), "total_negative": n(y == 0),
        "header_label_mismatches": n(at(tested) & ~F.col("header_label_consistent")), "nonstandard_rows": n(~F.col("valid_alphabet")), "within_split_duplicate_rows": n(F.col("duplicated_within_split")),
        "overlap_sequences": F.count_distinct(F.when(F.col("cross_split_overlap"), F.col("sequence"))), "conflicting_label_rows": n(F.col("conflicting_label")),
        "found_positive": n(F.col("found_elsewhere") & (y == 1)), "found_negative": n(F.col("found_elsewhere") & (y == 0)),
    }
    got = manifest.agg(*(c.alias(k) for k, c in found.items())).first().asDict()
    a, c = got["found_positive"], got["found_negative"]
    odds, p = fisher_exact(a, got["total_positive"] - a, c, got["total_negative"] - c) if a + c else (math.nan, math.nan)
    got |= {"reported_positive": reported[0], "reported_negative": reported[1], "counts_are_transposed": (got["total_positive"], got["total_negative"]) == reported[::-1], "odds_ratio": round(odds, 6), "fisher_p": float(f"{p:.6g}")}
    return manifest.sparkSession.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in got.items()], "item string, value string")


def same_rows(left: DataFrame, right: DataFrame, columns: list[str]) -> bool:
    """Whether two tables hold the same rows as often: says if a cached table still fits its input."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of [[a, b], [c, d]]."""
    odds = math.inf if b * c == 0 and a * d > 0 else (math.nan if b * c == 0 else a * d / (b * c))
    lf = lambda n: math.lgamma(n + 1)
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    logp = lambda x: lf(r1) + lf(r2) + lf(c1) + lf(n - c1) - lf(n) - lf(x) - lf(r1 - x) - lf(c1 - x) - lf(r2 - c1 + x)
    own = logp(a)
    return odds, min(1.0, sum(math.exp(p) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (p := logp(x)) <= own + 1e-7))


def require(rows: DataFrame, sequence: str = "sequence", label: str = "label", expected: int | None = None, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> dict:
    """Counts of contract violations in one pass; raises ValueError with up to three offenders."""
    bad = ~F.coalesce(F.col(sequence).rlike(f"^[{alphabet}]+$"), F.lit(False)) | (F.col(label).isNotNull() & ~F.col(label).isin(0, 1))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} rows break the contract, such as {[r.asDict() for r in rows.where(bad).limit(3).collect()]}")
    if expected is not None and seen["n"] != expected:
        raise ValueError(f"{seen['n']} rows instead of {expected}")
    return seen.asDict()


def drift(left: DataFrame, right: DataFrame, on: list[str], value: str, tolerance: float) -> float:
    """Largest absolute difference of a value between two tables; raises ValueError above tolerance or if keys differ."""
    both = left.select(*on, F.col(value).alias("a"), F.lit(1).alias("la")).join(right.select(*on, F.col(value).alias("b"), F.lit(1).alias("lb")), on, "full")
    got = both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"), F.count_if(F.col("la").isNull() | F.col("lb").isNull()).alias("alone")).first()
    if got["alone"] or (got["d"] or 0.0) > tolerance:
        raise ValueError(f"{got['alone']} keys on one side only, largest difference {got['d']}")
    return got["d"] or 0.0


def file_integrity(spark, path: str, manifest: DataFrame) -> DataFrame:
    """(name, status) of a manifest of (name, bytes, sha256): ok, missing, size or hash."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("_n"), F.sha2("content", 256).alias("_h"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_h") != F.col("sha256"), "hash").otherwise("ok")
    return manifest.join(files, "name", "left").select("name", status.alias("status"))


def prediction_counts(rows: DataFrame, models: list[str], row: str = "row_idx") -> DataFrame:
    """(model, n, missing, non_finite, outside, repeated): of every prediction column its rows, nulls, NaN and infinite
    values, values outside 0 to 1, and rows whose id was there before."""
    stacked = rows.select(F.col(row).alias("_row"), F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models))).alias("x")).select("_row", "x.*")
    p = F.col("p")
    odd = F.isnan(p) | (F.abs(p) == math.inf)
    ids = rows.groupBy(F.col(row).alias("_row")).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated"))  # one row
    each = stacked.groupBy("model").agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("missing"), F.count_if(odd).alias("non_finite"), F.count_if(~odd & ((p < 0) | (p > 1))).alias("outside"))
    return each.join(F.broadcast(ids))


def require_predictions(rows: DataFrame, models: list[str], expected: int, row: str = "row_idx") -> DataFrame:
    """rows, if every model has a finite probability for each of the expected rows; else ValueError says what is amiss.

    No model at all raises too.
    """
    if not models:
        raise ValueError("no predictions")
    found = {r["model"]: r for r in prediction_counts(rows, models, row).collect()}  # a row to each model
    for m in models:
        r = found[m].asDict() if m in found else {"n": 0}
        amiss = {k: v for k, v in r.items() if k not in ("model", "n") and v}
        if r["n"] != expected or amiss:
            raise ValueError(f"{m}: {r['n']} rows of {expected}, {amiss}")
    return rows
