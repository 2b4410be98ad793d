"""FASTA as tables, and labels from record headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))


def parse(files: DataFrame, file: str = "file", content: str = "content", strict: bool = False, keep_case: bool = False) -> DataFrame:
    """(file, record, header, sequence): the records of every file, numbered from 1.

    Blank lines are skipped, lines of a record joined, inner spaces removed and letters upper-cased unless keep_case.
    Text before the first header is dropped, or raises if strict.  A header without lines has an empty sequence.
    """
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(F.coalesce(content, F.lit("")), "\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line != ''")
    numbered = lines.withColumn("head", F.col("line").startswith(">")).withColumn("record", F.sum(F.col("head").cast("long")).over(W.partitionBy("file").orderBy("pos")))
    if strict:
        numbered = numbered.withColumn("record", F.when(F.col("record") == 0, F.raise_error("text before the first header")).otherwise(F.col("record")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "")
    made = numbered.where("record > 0").groupBy("file", "record").agg(F.max(F.when(F.col("head"), F.expr("trim(substring(line, 2))"))).alias("header"), F.replace(body, F.lit(" "), F.lit("")).alias("sequence"))
    return made if keep_case else made.withColumn("sequence", F.upper("sequence"))


def scan(spark: SparkSession, path: str, strict: bool = False, keep_case: bool = False) -> DataFrame:
    """parse() of the files at a path, read in byte ranges: a file of any size is many tasks' work.

    Spark's reader cuts files into ranges at line ends.  A first pass counts the headers of every range, so each range
    knows the number of its first record; lines before its first header belong to the last record of the ranges before.
    Only the lines of one record meet in one row.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("pos"), F.trim(F.regexp_replace("value", "\r$", "")).alias("line")).where("line != ''")
    lines = raw.withColumn("head", F.col("line").startswith(">"))
    ranges = lines.groupBy("file", "range").agg(F.count_if("head").alias("heads"))  # a row to each range
    before = ranges.withColumn("before", F.coalesce(F.sum("heads").over(W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("heads")
    own = F.sum(F.col("head").cast("long")).over(W.partitionBy("file", "range").orderBy("pos"))
    numbered = lines.withColumn("own", own).join(F.broadcast(before), ["file", "range"]).withColumn("record", F.col("own") + F.col("before"))
    if strict:
        numbered = numbered.withColumn("record", F.when(F.col("record") == 0, F.raise_error("text before the first header")).otherwise(F.col("record")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("range", "pos", "line")))), lambda x: x["line"]), "")
    made = numbered.where("record > 0").groupBy("file", "record").agg(F.max(F.when(F.col("head"), F.expr("trim(substring(line, 2))"))).alias("header"), F.replace(body, F.lit(" "), F.lit("")).alias("sequence"))
    return made if keep_case else made.withColumn("sequence", F.upper("sequence"))


def record_id(header: Column) -> Column:
    return F.split(header, r"\s+")[0]


def label_last_field(header: Column) -> Column:
    """0 or 1 from the last field between bars; else from the first character; else 0."""
    last = F.element_at(F.split(header, "[|]"), -1)
    first = F.substring(header, 1, 1)
    return F.when(last.isin("0", "1"), last.cast("int")).when(first.isin("0", "1"), first.cast("int")).otherwise(0)


def label_first_char(header: Column) -> Column:
    """0 or 1 from the first character, else from the first field that is one of them, else null."""
    first = F.substring(header, 1, 1)
    field = F.filter(F.split(header, "[|]"), lambda x: x.isin("0", "1"))
    return F.when(first.isin("0", "1"), first.cast("int")).otherwise(F.get(field, F.lit(0)).cast("int"))


# Parts of headers that tell a class.
POSITIVE_TOKENS = ("positive", "pos", "antioxidant", "anox")
NEGATIVE_TOKENS = ("negative", "neg", "non-antioxidant", "non_antioxidant", "nonanox")


def label_tokens(header: Column, positive: tuple[str, ...] = POSITIVE_TOKENS, negative: tuple[str, ...] = NEGATIVE_TOKENS, strict: bool = False) -> Column:
    """From tokens anywhere in the header; negative ones win; without any null, or an error if strict."""
    low = F.lower(F.trim(header))
    some = lambda tokens: reduce(Column.__or__, (low.contains(t) for t in tokens))
    out = F.when(some(negative), 0).when(some(positive), 1)
    return out.otherwise(F.raise_error(F.concat(F.lit("no label in header "), header)).cast("int")) if strict else out


# What stands before and after a delimited label.
DELIMITED = r"(?:^|[|_\-])%s(?:$|[|_\-])"


def label_delimited(header: Column) -> Column:
    """From a 1 or "pos" that stands between delimiters, then a 0 or "neg" that does; else null."""
    low = F.lower(F.trim(header))
    between = lambda *tokens: reduce(Column.__or__, (low.rlike(DELIMITED % t) for t in tokens))
    return F.when(between("1", "pos"), 1).when(between("0", "neg"), 0)


def unique_record_ids(records: DataFrame, record_id: str = "record_id", row: str = "row_idx", prefix: str = "record") -> DataFrame:
    """records with their ids, or, if any id occurs twice, all ids as prefix, underscore and the row's number in five digits."""
    most = records.groupBy(record_id).agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) > 1).alias("_twice"))  # one row
    return records.join(F.broadcast(most)).withColumn(record_id, F.when(F.col("_twice"), F.format_string(f"{prefix}_%05d", F.col(row).cast("long"))).otherwise(F.col(record_id))).drop("_twice")


def load_sets(files: dict[str, tuple[DataFrame, int | None]], expected: dict[str, int | tuple[int, int, int]] | None = None, alphabet: str = "ACDEFGHIKLMNPQRSTVWY", drop_invalid: bool = False, distinct: bool = False) -> DataFrame:
    """(split, file, record, header, record_id, sequence, label) of named sets of files, checked.

    files maps a split to its (file, content) table, or its records as parse() and scan() give them, and the label of
    all its records, null to read labels from the last field of headers.  A sequence that is empty or leaves the
    alphabet raises, or goes with drop_invalid; distinct then keeps the first record, by file and number, of each
    sequence of a split.  A split raises that has not the expected number of records, or of records, ones and zeros.
    """
    out = None
    for split, (table, label) in files.items():
        own = (table if "sequence" in table.columns else parse(table, strict=True)).select("file", "record", "header", "sequence")
        own = own.withColumns({"split": F.lit(split), "record_id": record_id(F.col("header")), "label": F.lit(label).cast("int") if label is not None else label_last_field(F.col("header"))})
        out = own if out is None else out.unionByName(own)
    valid = F.col("sequence").rlike(f"^[{alphabet}]+$")
    if drop_invalid:
        out = out.where(valid)
    if distinct:
        rest = F.struct("file", "record", "header", "record_id", "label")
        out = out.groupBy("split", "sequence").agg(F.min(rest).alias("_r")).select("split", "sequence", "_r.*")
    counts = {r["split"]: r for r in out.groupBy("split").agg(F.count("*").alias("n"), F.count_if(~valid).alias("bad"), F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros")).collect()}  # a row to each split
    for split in files:
        n, bad, ones, zeros = (counts[split][c] for c in ("n", "bad", "ones", "zeros")) if split in counts else (0, 0, 0, 0)
        want = (expected or {}).get(split)
        if bad or want is not None and want not in (n, (n, ones, zeros)):
            raise ValueError(f"{split}: {n} records, {ones} ones and {zeros} zeros, {bad} of them invalid; expected {want}")
    return out.select("split", "file", "record", "header", "record_id", "sequence", "label")
