"""Phrases of two and three words whose words keep company, from counts in counting quotient filters.

Words that occur often enough get ids; no phrase with another word can be frequent, so leaving the others out loses
nothing.  Ids of a phrase are packed, permuted and counted in filters (quotient.py): a task makes sorted filters of
its blocks, one for each range of the permuted keys, and each range's filters are merged by one task.  Ranges are as
many as the corpus needs, and the permutation keeps them even; a very frequent phrase is one counter in each filter.

The ids of the most frequent words, ONE_READ at most, are a broadcast of bounded size; the ids of other words are joined
to the words of each document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C
from . import quotient
from .linededup import frequent

LEAST, TOP = 10, 2000
#: Words whose ids are broadcast.
ONE_READ = 400_000
#: Words counted before a task hands its counts on; words of a block of phrases; words of a range of keys.
KEPT_WORDS, BLOCK, RANGE = 200_000, 1_000_000, 500_000
#: A longer phrase explains a shorter one if it makes up so many hundredths of it.
EXPLAINED = 50

_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; b"\\n" stands between pieces, and empty words may occur."""
    return (text or "").encode().lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of all words; a null lang is und."""

    def table(counts: dict) -> pa.RecordBatch:
        rows = [(l, w, n) for l, c in counts.items() for w, n in c.items() if w not in (b"", b"\n")]
        l, w, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(l, pa.string()), pa.array([x.decode() for x in w], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for l, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts.setdefault(l, Counter()).update(tokens(x.as_py()))
            if sum(map(len, counts.values())) > KEPT_WORDS:
                yield table(counts)
                counts = {}
        yield table(counts)

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), text).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Block:
    """Ids of documents until they are enough for filters of their phrases."""

    def __init__(self, w: int, prefix: int):
        self.w, self.prefix, self.parts, self.size = w, prefix, [], 0

    def add(self, ids: np.ndarray) -> bool:
        """Whether the block is full; ids below 0 part phrases, and documents are parted by one."""
        self.parts += [ids, np.array([-1])]
        self.size += len(ids)
        return self.size >= BLOCK

    def filters(self) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        self.parts, self.size = [], 0
        w, shift = self.w, np.uint64(2 * self.w - self.prefix)
        two = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
        three = two[:-1][np.diff(two) == 1] if len(two) else two
        at = np.concatenate([two, three])
        left = x[at].astype(np.uint64) << np.uint64(w) | x[at + 1].astype(np.uint64)
        right = np.concatenate([np.zeros(len(two), np.uint64), (x[three + 2] + 1).astype(np.uint64)])
        left, right, n = quotient.sorted_counts(*quotient.permute(left, right, w), w)
        ranges, begin = np.unique(left >> shift, return_index=True)
        for r, lo, hi in zip(ranges.tolist(), begin, np.append(begin, len(left))[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([quotient.encode(left[lo:hi], right[lo:hi], n[lo:hi], w, self.prefix)], pa.binary())], names=["range", "filter"])


def _merged(filters: DataFrame, w: int, prefix: int, least: int, tasks: int) -> DataFrame:
    """(a, b, c, n): ids and counts of at least least of every phrase; c is -1 for phrases of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        def merge() -> None:
            nonlocal parts, size
            parts = [quotient.sorted_counts(*(np.concatenate(x) for x in list(zip(*parts, strict=True))[:2]), w, np.concatenate([p[2] for p in parts]))]
            size = len(parts[0][0])

        def done() -> pa.RecordBatch:
            merge()
            left, right, n = (x[parts[0][2] >= least] for x in parts[0])
            left, right = quotient.restore(left, right, w)
            a, b = left >> np.uint64(w), left & np.uint64((1 << w) - 1)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b)] + [pa.array(right.astype(np.int64) - 1), pa.array(n)], names=["a", "b", "c", "n"])

        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now and parts:
                    yield done()
                    parts, size = [], 0
                now = r
                parts.append(quotient.decode(data.as_py(), w, prefix, r))
                size += len(parts[-1][0])
                if size > max(4_000_000, 2 * len(parts[0][0])):
                    merge()
        if parts:
            yield done()

    return filters.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(run, "a long, b long, c long, n long")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) by whole numbers of 38 digits: exact for counts below 10**15; at most 1000000."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * d(a) * d(a), d(l) * d(r))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, one_read: int = ONE_READ) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every lang.

    Words are the runs of [^\\x20\\x09] in pieces between [.,;:!?\\x0A-\\x0D], A-Z in lower case.  A null text has none and a null lang
    is und.  a, l and r count the phrase and the parts of its lowest-scoring cut, n all words of the lang.  Phrases in a
    longer one that makes up half of them go.  Ties are broken by a, then by the phrase's bytes; repeated rows count
    again, and other columns are not read.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    every = C.materialize(word_counts(docs, text, lang), "words", "zstd")
    totals = C.materialize(every.groupBy("lang").agg(F.sum("n").alias("n")), "langs")
    words = every.where(F.col("n") >= least)
    found, size = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    floor = 0 if found <= one_read else frequent(words, one_read)
    named = _numbered(words)
    head = named.where(F.col("n") >= floor).select("lang", "word", "id").toArrow()  # one_read rows at most
    ids: dict[str, dict[bytes, int]] = {}
    for l, x, k in zip(*(c.to_pylist() for c in head.columns), strict=True):
        ids.setdefault(l, {b"": -2})[x.encode()] = k
    known = spark.sparkContext.broadcast(ids)
    del head, ids
    tail = named.where(F.col("n") < floor) if floor else None
    w = max(2, found.bit_length())
    if w > 31:
        raise ValueError("more than 2**31 words of that count")
    prefix = min(2 * w - 1, max(6, (size // RANGE).bit_length()))
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text)
    filters = (_head_filters(source, known, w, prefix) if tail is None else _all_filters(source, known, tail, w, prefix))
    grams = C.materialize(_merged(filters, w, prefix, least, C.width(size, 1_000_000)), "phrases", "zstd")
    return _best(grams, named, totals, top)


def _head_filters(source: DataFrame, known, w: int, prefix: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(w, prefix)
        for b in batches:
            for l, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                get = known.value.get(l, {b"": -2}).get
                found = np.array([get(t, -1) for t in tokens(x.as_py())], np.int64)
                if block.add(found[found > -2]):
                    yield from block.filters()
        yield from block.filters()

    return source.mapInArrow(run, "range long, filter binary")


def _all_filters(source: DataFrame, known, tail: DataFrame, w: int, prefix: int) -> DataFrame:
    """The same when not all ids are known: a document's other words are joined with their ids, and its ids completed."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, others = [], []
            for l, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                get, new = known.value.get(l, {b"": -2}).get, {}
                ids.append([k for k in (-1 if t == b"\n" else get(t) if get(t) is not None else -3 - new.setdefault(t, len(new)) for t in tokens(x.as_py())) if k != -2])
                others.append([t.decode() for t in new])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.string()))], names=["lang", "ids", "others"])

    coded = C.materialize(source.mapInArrow(code, "lang string, ids array<long>, others array<string>").withColumn("_row", F.monotonically_increasing_id()), "coded", "zstd")
    asked = coded.select("_row", "lang", F.posexplode("others").alias("k", "word"))
    given = asked.join(tail.select("lang", "word", "id"), ["lang", "word"]).groupBy("_row").agg(F.collect_list(F.struct("k", "id")).alias("given"))  # one document's words
    whole = coded.select("_row", "ids").join(given, "_row", "left").select("ids", F.col("given.k").alias("k"), F.col("given.id").alias("id"), F.array_max(F.transform("ids", lambda x: -x)).alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(w, prefix)
        for b in batches:
            for ids, ks, new, most in zip(*(b.column(c) for c in range(4)), strict=True):
                x = np.array(ids.as_py(), np.int64)
                names = np.full(max(0, (most.as_py() or 0) - 2), -1, np.int64)
                if ks.is_valid:
                    names[np.array(ks.as_py(), np.int64)] = new.as_py()
                other = x <= -3
                x[other] = names[-3 - x[other]]
                if block.add(x):
                    yield from block.filters()
        yield from block.filters()

    return whole.mapInArrow(run, "range long, filter binary")


def _numbered(words: DataFrame) -> DataFrame:
    """words with ids from 0 on, without gaps."""
    low = (1 << 33) - 1  # the place within its partition
    written = C.materialize(words.withColumn("_m", F.monotonically_increasing_id()), "ids", "zstd")
    part = F.shiftright("_m", 33).alias("part")
    sizes = sorted((r["part"], r["k"]) for r in written.groupBy(part).agg(F.count("*").alias("k")).collect())  # a row to a partition
    starts = np.cumsum([0, *(k for _, k in sizes)])
    offsets = written.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=False)] or [(0, 0)], "part long, start long")
    return written.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("id", F.col("start") + F.col("_m").bitwiseAND(low)).select("lang", "word", "n", "id")


def _best(grams: DataFrame, named: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    def name(df: DataFrame, column: str) -> DataFrame:
        """df with the word, count and lang of an id."""
        return df.join(named.select(F.col("id").alias(column), *(F.col(c).alias(f"{column}_{c}") for c in ("word", "n", "lang"))), column)

    two, three = grams.where("c < 0").select("a", "b", "n"), grams.where("c >= 0")
    longer = three.select("a", "b", "n").unionByName(three.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longest"))
    own = two.join(longer, ["a", "b"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < EXPLAINED * F.col("n")))
    own = name(name(own, "a"), "b")
    pairs = own.select(F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("n").alias("a"), F.col("a_n").alias("l"), F.col("b_n").alias("r"), _score(F.col("n"), F.col("a_n"), F.col("b_n")).alias("score"))
    split = three.join(two.select("a", "b", F.col("n").alias("ab")), ["a", "b"]).join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc")), ["b", "c"])
    split = name(name(name(split, "a"), "b"), "c")
    n = F.col("n")
    cuts = F.least(F.struct(_score(n, F.col("a_n"), F.col("bc")).alias("score"), F.lit(1).alias("k"), F.col("a_n").alias("l"), F.col("bc").alias("r")), F.struct(_score(n, F.col("ab"), F.col("c_n")).alias("score"), F.lit(2).alias("k"), F.col("ab").alias("l"), F.col("c_n").alias("r")))
    triples = split.select(F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), n.alias("a"), cuts.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    every = pairs.unionByName(triples).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = every.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


_SQL = rf"""WITH w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    f1 AS MATERIALIZED (SELECT lang, x AS p, count(*) AS n FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
    f2 AS MATERIALIZED (SELECT lang, x AS p, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS x FROM w) GROUP BY ALL HAVING count(*) >= {LEAST}),
    f3 AS MATERIALIZED (SELECT lang, x AS p, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS x FROM w) GROUP BY ALL HAVING count(*) >= {LEAST}),
    t AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang),
    f AS MATERIALIZED (FROM f1 UNION ALL FROM f2),
    e AS MATERIALIZED (SELECT lang, p AS phrase, n AS a, string_split(p, ' ') AS ws FROM f3),
    c AS MATERIALIZED (SELECT lang, p AS phrase, n AS a, 1 AS j, split_part(p, ' ', 1) AS lp, split_part(p, ' ', 2) AS rp FROM f2 UNION ALL SELECT lang, phrase, a, 1, ws[1], ws[2] || ' ' || ws[3] FROM e UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM e),
    s AS (SELECT c.lang, c.phrase, c.a, j, p.n AS l, q.n AS r, (1000000::HUGEINT * a * a) // (p.n::HUGEINT * q.n) AS score FROM c JOIN f p ON p.lang = c.lang AND p.p = lp JOIN f q ON q.lang = c.lang AND q.p = rp),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    x AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, ws[1] || ' ' || ws[2] AS phrase FROM e UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM e) GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, t.n, score::BIGINT AS score
    FROM b JOIN t ON t.lang = b.lang LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longest IS NULL OR 100 * longest < {EXPLAINED} * a QUALIFY rank <= {TOP}"""

SQL = {"op11_phrases": _SQL}
QUERIES = {"op11_phrases": op11_phrases}
