"""Arrow batches of one row, for rows that hold whole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """The setting for what runs inside; the session's own comes back."""
    old = spark.conf.get(_KEY)
    spark.conf.set(_KEY, "1")
    try:
        yield
    finally:
        spark.conf.set(_KEY, old)
