"""Delimited, JSON and matrix tables in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with header and a given schema: types are never inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV parts with headers; one part only for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) from a JSON object whose "files" map names to their size and hash."""
    schema = "files map<string, struct<bytes: long, sha256: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("files").alias("name", "v")).select("name", "v.bytes", "v.sha256")


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object on each line, fields in alphabetic order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def import_matrix(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """(row_idx, values) of a two-dimensional .npy file on the driver's disk: a one-off importer for small matrices."""
    import numpy as np
    import pandas as pd

    m = np.load(path, mmap_mode="r")
    pieces = [spark.createDataFrame(pd.DataFrame({"row_idx": np.arange(a, min(a + 10_000, len(m))), "values": [x.tolist() for x in m[a : a + 10_000]]}), "row_idx long, values array<double>") for a in range(0, len(m), 10_000)]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.repartition(parts)


def scan_matrix(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """(row_idx, values) of a two-dimensional .npy file of numbers in a folder that all executors share, each task reading row ranges of
    its own; the driver reads the header alone.  A file that is no such matrix, or too short for its header, raises."""
    import os

    import numpy as np
    import pyarrow as pa

    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        begin = f.tell()
    if len(shape) != 2 or by_column or kind.kind not in "iuf":
        raise ValueError(f"{path} is no matrix of numbers by rows")
    n, width = shape
    if os.path.getsize(path) < begin + n * width * kind.itemsize:
        raise ValueError(f"{path} ends early")

    def run(batches):
        for b in batches:
            for lo in b.column(0).to_pylist():
                hi = min(lo + rows, n)
                with open(path, "rb") as f:
                    f.seek(begin + lo * width * kind.itemsize)
                    block = np.frombuffer(f.read((hi - lo) * width * kind.itemsize), kind).astype(np.float64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * width), pa.array(block))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), values], names=["row_idx", "values"])

    blocks = max(1, -(-n // rows))
    return spark.range(0, n, rows, min(blocks, 10_000)).mapInArrow(run, "row_idx long, values array<double>")


def true_text(column: Column) -> Column:
    """Whether a text says true, 1 or yes, in any case and with spaces around."""
    return F.lower(F.trim(column)).isin("true", "1", "yes")
