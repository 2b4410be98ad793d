"""Line deduplication by perfect hashes against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import linededup
from strandlake.llm.perfect_hash import PerfectHash, build

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(FOLD)
    holds = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holds[k].append(d)
    low = lambda d: -(2**63) if d is None else d
    last = {k: max(map(low, v)) for k, v in holds.items() if len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if last.get(key(x), low(d)) == low(d)]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def table():
    rng = np.random.default_rng(0)
    pool = [f"Line {k} " + " ".join(rng.choice(["alpha", "Beta", "été", "漢字"], 8)) + " tail" for k in range(60)]
    pool += ["x" * 40, "x" * 39, "é" * 40, "é" * 39, " " + "y" * 39, "É" * 45, "short"]
    rows = [(k, "\n".join(("  " if rng.random() < 0.3 else "") + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + ("\r" if rng.random() < 0.2 else "") for x in rng.choice(pool, rng.integers(1, 12)))) for k in range(120)]
    rows += [(500 + k, "hot line that every document of a large source holds at its end\nown " + str(k)) for k in range(80)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, pool[0]), (None, pool[1] + "\n" + pool[1]), (903, pool[2]), (903, pool[2]), (904, "\n".join(pool * 200)), (905, "z" * 200_000)]
    rows += [(None, "only documents without an id hold this line, many of them")] * 6
    return rows


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        a[: n // 2] = 7  # halves that many share
        h = PerfectHash(*build(a, b))
        assert h.n == n and sorted(h.slots(a, b)) == list(range(n))
    with pytest.raises(ValueError):
        build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


@pytest.mark.parametrize("one_read, shard_keys", [(1_000_000, 100_000), (10, 4), (0, 7)])
def test_lines(spark, one_read, shard_keys):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("mine"), "shard": F.lit(3), "key": F.lit(None).cast("string")})
    got = linededup.drop_lines(docs, one_read=one_read, shard_keys=shard_keys)
    assert got.columns == ["doc_id", "shard", "key", "text", "n_lines", "n_dropped"]
    digest = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert sorted(map(tuple, digest), key=repr) == brute(rows)
    assert got.where("text IS NULL").count() == 1


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.drop_lines(docs).count() == 0
    assert linededup.drop_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["n_dropped"] == 0


def test_query_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{d}/documents.parquet'")
    assert sorted(map(tuple, linededup.op12_line_dedup(spark, d).collect())) == sorted(con.sql(linededup.SQL["op12_line_dedup"]).fetchall())
