"""Scratch tables in the cluster's shared folder, and words of whole Arrow text columns as hashed NumPy arrays.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``.  All of that white space is ASCII, so words are found on
UTF-8 bytes without decoding them.  A null text has no words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together in one NumPy pass, in bytes; a longer single text makes its own pass.
CHUNK_BYTES = 1 << 20
#: Rows of one Arrow batch sent to Python: bounds a batch when many texts are long.
ARROW_ROWS = 1000

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(_own_dirs[app])
        base = _own_dirs[app]
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet below scratch_dir() and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class batch_rows:
    """Arrow batches of so many rows for the plans that are made and run inside; the session's setting comes back."""

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, rows: int):
        self.spark, self.value = spark, str(rows)

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(self.key)
        self.spark.conf.set(self.key, self.value)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.key, self.old)


class shuffles_dropped(batch_rows):
    """Shuffle files go as soon as a table is written inside, not when the driver happens to collect its garbage."""

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.value = spark, "true"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches, so that a batch of long texts stays small; smaller settings stay.

    Results are lazy, so the setting must outlast the call: it is the session's, as its other Arrow settings are.
    """
    if int(spark.conf.get(batch_rows.key)) > ARROW_ROWS or int(spark.conf.get(batch_rows.key)) <= 0:
        spark.conf.set(batch_rows.key, str(ARROW_ROWS))


def give_back() -> None:
    """Free memory that Arrow and the C library keep for later goes back to the machine, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(ctypes.c_size_t(0))


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives free memory back at the end of a task: it stays beside the stages that follow."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


#: A class of equal rows is hot if it has more than one row in so many; so there are at most so many hot classes.
HOT = 1000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], total: int, how: str) -> DataFrame:
    """rows joined with classes, one row to each key with the number of its rows in members (dropped here).

    Hot classes, HOT at most, are broadcast, so that their rows stay where they are; the rest is joined by shuffling.
    """
    hot, rest = (classes.where(c).drop("members") for c in (F.col("members") > total // HOT, F.col("members") <= total // HOT))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys, how))


def width(rows: int, per: int = 200_000, least: int = 8) -> int:
    """Tasks for a stage over so many rows: small tables need not the session's number of shuffle partitions."""
    return max(least, -(-rows // per))


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo by: the fixed split between training and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % by


_M64 = (1 << 64) - 1
_R = 0x9E3779B97F4A7C13 | 3
_R = (_R & ~7) | 3  # 3 modulo 8: R**k - 1 keeps few factors of two
_RI = pow(_R, -1, 1 << 64)
_rng = np.random.default_rng(0x5EED)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, r in enumerate((_R, _RI)):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of consecutive texts: byte spans, 64-bit fingerprints and the text each lies in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool):
        """data: UTF-8 bytes of all texts; offsets: where each begins, and the end."""
        n = len(data)
        word = ~_SPACE[data]
        begins, stops = word.copy(), word.copy()
        if n:
            begins[1:] &= ~word[:-1]
            stops[:-1] &= ~word[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            begins[inner] = word[inner]
            stops[inner - 1] = word[inner - 1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(offsets[1:], self.starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.bounds = np.concatenate(([0], np.cumsum(self.counts)))
        p, pi = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold_case else _VALUES)[data] * p[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * pi[self.starts])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying its text; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about size bytes; every row is in one run."""
    data, offsets = text_buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
