"""Toxicity by class-conditional Kneser-Ney models of the bytes of words.

Each class has interpolated Kneser-Ney probabilities of a byte after the ORDER - 1 bytes before it within its word.
Below the highest order both classes share one set of continuation counts, so an expression too rare to say
anything backs off to the same probability in both and moves no score.  A text's measure is the difference of its
toxic and ordinary log-likelihoods per word; a logistic curve, fitted on sampled rows kept out of the counts, turns
it into a probability.

Spark counts the n-grams and makes all tables.  The classes keep probabilities of their own only for n-grams in which
a likelihood-ratio test on documents rejects equal rates and both the probabilities and the shares of documents
differ clearly the same way; all other n-grams take one shared probability in both.  So a text's likelihoods differ by
a sum over a small table of n-grams, and neither the mix of languages nor the accidents of a few documents move it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

ORDER = 8
DISCOUNT = 0.75
#: Least likelihood-ratio statistic (one degree of freedom) and least log ratio of an n-gram with class counts.
TEST, EFFECT = 8.0, float(np.log(2.5))
#: Bound of the labelled sample that is learnt from, in expected rows of each class; all labelled rows if fewer.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 6_000, 12_000
#: One sampled row in so many fits the curve instead of the counts.
CALIBRATION = 5
CLASSES = ("toxic", "ordinary")

_U = np.uint64


def word_grams(words: C.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the picked words, with a space at the end, and how many each word has."""
    starts, ends = words.starts[pick], words.ends[pick]
    lengths = ends - starts
    padded = lengths + ORDER  # ORDER - 1 zeros, the word, a space
    stops = np.cumsum(padded)
    text = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    inner = np.repeat(starts - (stops - padded) - (ORDER - 1), lengths) + _ragged(stops - padded + ORDER - 1, lengths)
    text[_ragged(stops - padded + ORDER - 1, lengths)] = words.data[inner]
    text[stops - 1] = 0x20
    upper = (text >= 65) & (text <= 90)
    text[upper] += 32
    grams = np.zeros(len(text), _U)
    for k in range(ORDER):
        grams[k:] |= text[: len(text) - k].astype(_U) << _U(8 * k)
    own = np.ones(len(text), bool)
    for k in range(ORDER - 1):
        own[stops - padded + k] = False
    return grams[own], lengths + 1


def _ragged(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every run."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(firsts - before, lengths)


def _look(keys: np.ndarray, values: np.ndarray, x: np.ndarray, default: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), default)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], default)


@dataclass
class Model:
    """Log probabilities of the n-grams in which the classes differ, in order of the n-grams; all others are shared."""

    grams: np.ndarray
    toxic: np.ndarray
    ordinary: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def logs(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(byte | toxic) and log P(byte | ordinary) of packed n-grams; 0 where the classes share one."""
        return _look(self.grams, self.toxic, grams), _look(self.grams, self.ordinary, grams)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.shift, -700, 700)))


def _suffix(k: int) -> Column:
    """The last k bytes of a packed n-gram."""
    return F.col("gram") if k == ORDER else F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))


def last_byte_probabilities(counted: DataFrame) -> Column:
    """Continuation probability of an n-gram's last byte: the lowest order, of 256 values."""
    pairs = counted.select(_suffix(2).alias("pair")).distinct()
    many = {r["b"]: r["n"] for r in pairs.groupBy(F.col("pair").bitwiseAND(F.lit(255)).alias("b")).agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(many.values()))
    p = [(max(many.get(b, 0) - DISCOUNT, 0) + DISCOUNT * len(many) / 256) / total for b in range(256)]
    return F.element_at(F.array(*map(F.lit, p)), _suffix(1).cast("int") + 1)


def probabilities(counted: DataFrame) -> DataFrame:
    """counted (gram and counts) with shared, toxic and ordinary log probabilities of each n-gram's last byte.

    Orders below the highest are interpolated Kneser-Ney over the number of distinct longer n-grams that end in an
    n-gram, shared by both classes; the highest order discounts the class's own occurrences.  All contexts and
    suffixes of an n-gram keep the byte before the last, so one exchange by that byte serves all windows.
    """
    rows = counted.withColumn("before", F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(255))).repartition("before")
    over = lambda *keys: W.partitionBy("before", *keys)
    whole = lambda *keys: over(*keys).orderBy("gram").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"shared": last_byte_probabilities(counted), "first": F.lit(1)})
    for k in range(ORDER - 1, 1, -1):
        # many: distinct (k + 1)-grams that end in this k-gram; own: marks one row of each k-gram.
        rows = rows.withColumn("suffix", _suffix(k))
        rows = rows.withColumns({f"many{k}": F.sum("first").over(whole("suffix")), "own": (F.row_number().over(over("suffix").orderBy("gram")) == 1).cast("int")})
        rows = rows.withColumn("context", F.shiftrightunsigned("suffix", 8))
        rows = rows.withColumns({f"total{k}": F.sum(F.col(f"many{k}") * F.col("own")).over(over("context")), f"kinds{k}": F.sum("own").over(over("context"))})
        rows = rows.drop("first").withColumnRenamed("own", "first")
    for k in range(2, ORDER):
        many, total, kinds = (F.col(f"{x}{k}") for x in ("many", "total", "kinds"))
        rows = rows.withColumn("shared", (F.greatest(many - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("shared")) / total)
    context = over("context")
    rows = rows.withColumn("context", F.shiftrightunsigned("gram", 8))
    rows = rows.withColumns({f"{x}_{c}": f.over(context) for c in CLASSES for x, f in (("total", F.sum(c)), ("kinds", F.count_if(F.col(c) > 0)), ("documents", F.sum(f"{c}_docs")))})
    for c in CLASSES:
        p = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{c}") * F.col("shared")) / F.col(f"total_{c}")
        rows = rows.withColumn(f"log_{c}", F.ln(F.when(F.col(f"total_{c}") > 0, p).otherwise(F.col("shared"))))
    kept = [*counted.columns, F.ln("shared").alias("log_shared"), *(f"{x}_{c}" for c in CLASSES for x in ("log", "total", "documents"))]
    return rows.select(*kept)


def class_table(rows: DataFrame, documents: tuple[int, int]) -> DataFrame:
    """(gram, log_toxic, log_ordinary) of the n-grams that have class counts of their own.

    documents: how many (ordinary, toxic) ones were counted.  The likelihood-ratio test compares the shares of
    documents with the n-gram among those with its context; the whole n-gram's share of all documents must differ the
    same way, as a byte may be rare after a context only because another one is frequent there in one class.
    """
    both = (F.col("toxic_docs") + F.col("ordinary_docs")) / (F.col("documents_toxic") + F.col("documents_ordinary"))
    g2 = F.lit(0.0)
    for c in CLASSES:
        seen, of = F.col(f"{c}_docs"), F.col(f"documents_{c}")
        for n, rate in ((seen, both), (of - seen, 1 - both)):
            g2 = g2 + F.when(n > 0, 2 * n * F.ln(n / F.greatest(of * rate, F.lit(1e-9)))).otherwise(0.0)
    value = F.col("log_toxic") - F.col("log_ordinary")
    share = F.ln((F.col("toxic_docs") + 0.5) / (documents[1] + 1.0)) - F.ln((F.col("ordinary_docs") + 0.5) / (documents[0] + 1.0))
    differ = (F.col("total_toxic") > 0) & (F.col("total_ordinary") > 0) & (g2 >= TEST) & (F.abs(value) >= EFFECT) & (F.abs(share) >= EFFECT) & (share * value > 0)
    return rows.where(differ).select("gram", "log_toxic", "log_ordinary")


class _Kept:
    """Log-likelihoods of words met by this worker, in a table of fixed size that new words overwrite."""

    SLOTS = 1 << 21

    def __init__(self) -> None:
        self.keys, self.values = np.zeros(self.SLOTS, _U), np.zeros((self.SLOTS, 2), np.float32)

    def of(self, model: Model, words: C.Words) -> np.ndarray:
        slot = (words.hashes & _U(self.SLOTS - 1)).astype(np.int64)
        out = self.values[slot].astype(np.float64)
        miss = np.flatnonzero(self.keys[slot] != words.hashes)
        if len(miss):
            new, first, back = np.unique(words.hashes[miss], return_index=True, return_inverse=True)
            grams, sizes = word_grams(words, miss[first])
            value = np.add.reduceat(np.column_stack(model.logs(grams)), np.cumsum(sizes) - sizes)
            out[miss] = value[back]
            at = (new & _U(self.SLOTS - 1)).astype(np.int64)
            self.keys[at], self.values[at] = new, value
        return out


_kept: dict[str, _Kept] = {}


def _kept_for(name: str) -> _Kept:
    if name not in _kept:
        _kept.clear()
        _kept[name] = _Kept()
    return _kept[name]


def text_likelihoods(model: Model, column: pa.Array) -> np.ndarray:
    """(texts, 2): toxic and ordinary log-likelihood of a word, in the mean of every text; 0 without words.

    Bytes whose probability both classes share would add the same to both and are left out.
    """
    kept, out = _kept_for(model.name), []
    for *_, data, offsets in C.chunks(column):
        w = C.Words(data, offsets, fold_case=True)
        sums = np.zeros((len(w.counts), 2))
        if len(w.doc):
            logs = kept.of(model, w)
            sums = np.column_stack([np.bincount(w.doc, logs[:, c], len(w.counts)) for c in (0, 1)])
        out.append(sums / np.maximum(w.counts, 1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, 2))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, bounds: tuple[int, int] = (SAMPLE_ORDINARY, SAMPLE_TOXIC)) -> DataFrame:
    """(doc_id, text, toxic, calibrate) of about so many labelled rows of each class, chosen by a hash of their ids.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest counts.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for c in (0, 1):
        share = F.when(F.col("toxic") == c, F.lit(min(1.0, bounds[c] / max(1, sizes.get(c, 0))))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(place < share).withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CALIBRATION)) == 0)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of a bounded number of rows


def class_grams(texts: pa.Array, toxic: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """n-grams of each chunk of texts and class, with their counts as count_grams() names them.

    A chunk's arrays, and the tables of powers that a worker keeps, are many times its bytes: it is no longer than others.
    """
    for a, to, data, offsets in C.chunks(texts):
        w = C.Words(data, offsets, fold_case=True)
        for c in (True, False):
            found = [(np.zeros(0, _U), np.zeros(0, np.int64))]
            for d in np.flatnonzero(toxic[a:to] == c):
                found.append(np.unique(word_grams(w, np.arange(w.bounds[d], w.bounds[d + 1]))[0], return_counts=True))
            own, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            times, docs = np.bincount(back, np.concatenate([n for _, n in found]), len(own)).astype(np.int64), np.bincount(back, minlength=len(own))
            none = np.zeros(len(own), np.int64)
            yield own, (times, none, docs, none) if c else (none, times, none, docs)


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary, toxic_docs, ordinary_docs) of (text, toxic): occurrences and documents of each class."""
    C.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, columns in class_grams(b.column(0), b.column(1).to_numpy(zero_copy_only=False) == 1):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *map(pa.array, columns)], names=["gram", "toxic", "ordinary", "toxic_docs", "ordinary_docs"])

    found = rows.select("text", "toxic").mapInArrow(C.gives_back(run), "gram long, toxic long, ordinary long, toxic_docs long, ordinary_docs long")
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in found.columns[1:]))


def fit(rows: DataFrame) -> Model:
    """The model of a bounded sample: Spark counts, smooths and tests; only n-grams that pass reach the driver."""
    counted = C.materialize(count_grams(rows.where("NOT calibrate")), "toxicity-counts")
    sizes = {r["toxic"]: r["n"] for r in rows.where("NOT calibrate").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t = class_table(probabilities(counted), (sizes.get(0, 0), sizes.get(1, 0))).toArrow()
    grams = t["gram"].to_numpy().view(_U)
    order = np.argsort(grams)
    model = Model(grams[order], *(t[c].to_numpy()[order].astype(np.float32) for c in ("log_toxic", "log_ordinary")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = text_likelihoods(model, b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(logs[:, 0] - logs[:, 1]), b.column(1)], names=["x", "toxic"])

    c = rows.where("calibrate").select("text", "toxic").mapInArrow(C.gives_back(measure), "x double, toxic int").toArrow()
    model.slope, model.shift = curve(c["x"].to_numpy(), c["toxic"].to_numpy().astype(float))
    return model


def curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method with a small penalty on the scaled slope."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, -2.0
    scale = x.std() or 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    w, ridge = np.zeros(2), np.diag([penalty, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T * (p * (1 - p) + 1e-9) @ design + ridge, design.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append log_toxic, log_ordinary (a word's, in the mean), score (0 to 1) and predicted (score >= 0.5) to every row.

    Null, empty and blank texts have no words: both likelihoods are 0 and the score the curve's at 0.  Columns of docs
    with these names are replaced.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    made = {"log_toxic": T.DoubleType(), "log_ordinary": T.DoubleType(), "score": T.DoubleType(), "predicted": T.IntegerType()}
    docs = docs.drop(*made)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            logs = text_likelihoods(m, b.column(at))
            s = m.score(logs[:, 0] - logs[:, 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logs[:, 0]), pa.array(logs[:, 1]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, *made])

    return docs.mapInArrow(C.gives_back(run), T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in made.items())]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows whose crc32 remainder by 5 is not 0."""
    return fit(sample(docs, labels, C.remainder("doc_id", 5) != 0))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (C.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "log_toxic", "log_ordinary")


SQL: dict[str, str] = {}
QUERIES = {"op8_toxicity": op8_toxicity}
