"""The dealt methods themselves against plain versions of them."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import _common as C
from strandlake.llm import toxicity

WORDS = "the of and river light morning grumpf grumpfing water stone of the and".split()


def sentence(seed, n, words=WORDS):
    return " ".join(np.random.default_rng(seed).choice(words, n))


def test_kneser_ney_probabilities(spark):
    texts = [(sentence(k, 12) + ("" if k % 3 else " grumpfest ÀB Grump"), int(k % 3 == 0)) for k in range(12)] + [(None, 1), ("", 0), (" ", 0)]
    counted = toxicity.count_grams(spark.createDataFrame(texts, "text string, toxic int"))
    grams, seen = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t, c in texts:
        own = []
        for w in (t or "").translate(fold).split():
            b = bytes(toxicity.ORDER - 1) + w.encode() + b" "
            own += [b[k : k + toxicity.ORDER] for k in range(len(b) - toxicity.ORDER + 1)]
        grams[c].update(own)
        seen[c].update(set(own))
    level = {toxicity.ORDER: {*grams[0], *grams[1]}}
    many = {}
    for k in range(toxicity.ORDER - 1, 0, -1):
        many[k] = Counter(g[1:] for g in level[k + 1])
        level[k] = set(many[k])
    d = toxicity.DISCOUNT

    def shared(g):
        if not g:
            return 1 / 256
        k = len(g)
        of = [n for x, n in many[k].items() if x[:-1] == g[:-1]]
        return (max(many[k][g] - d, 0) + d * len(of) * shared(g[1:])) / sum(of)

    def own(c, g):
        of = [n for x, n in grams[c].items() if x[:-1] == g[:-1]]
        return (max(grams[c][g] - d, 0) + d * len(of) * shared(g[1:])) / sum(of) if of else shared(g[1:])

    got = {(r["gram"] & (1 << 64) - 1).to_bytes(8, "big"): r for r in toxicity.probabilities(C.materialize(counted, "t")).collect()}
    assert set(got) == level[toxicity.ORDER]
    for g, r in got.items():
        assert (r["toxic"], r["ordinary"], r["toxic_docs"], r["ordinary_docs"]) == (grams[1][g], grams[0][g], seen[1][g], seen[0][g])
        for name, want in (("log_shared", shared(g[1:])), ("log_toxic", own(1, g)), ("log_ordinary", own(0, g))):
            assert math.isclose(r[name], math.log(want), rel_tol=1e-9, abs_tol=1e-9)
    # Of a context that a class has met, its probabilities and the mass of unseen bytes make one.
    context = next(g[:-1] for g in got if sum(x[:-1] == g[:-1] and grams[1][x] > 0 for x in got) > 1)
    assert math.isclose(sum(own(1, context + bytes([b])) for b in range(256)), 1, abs_tol=1e-6)


def test_counting_grams_keeps_no_large_tables(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setattr(C, "chunks", lambda column, size=1 << 14, real=C.chunks: real(column, size))
    monkeypatch.setattr(C, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts, toxic = [sentence(k, 100) for k in range(300)] + [None, ""], np.arange(302) % 3 == 0
    got = Counter()
    for own, columns in toxicity.class_grams(pa.array(texts), toxic):
        for g, *n in zip(own.tolist(), *(x.tolist() for x in columns), strict=True):
            got.update({(g, k): x for k, x in enumerate(n) if x})
    assert sum(len(t or "") for t in texts) > 8 * C.CHUNK_BYTES and len(C._powers[0]) <= C.CHUNK_BYTES + 2
    want = Counter()
    for t, c in zip(texts, toxic, strict=True):
        own = []
        for w in (t or "").split():
            b = bytes(toxicity.ORDER - 1) + w.encode() + b" "
            own += [int.from_bytes(b[k : k + toxicity.ORDER], "big") for k in range(len(b) - toxicity.ORDER + 1)]
        want.update((g, 0 if c else 1) for g in own)
        want.update((g, 2 if c else 3) for g in set(own))
    assert got == want


def test_workers_give_free_memory_back():
    import ctypes
    import re

    import pyarrow as pa
    import pytest

    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim"):
        pytest.skip("the C library gives nothing back")
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    pins = []

    def run(batches):
        for b in batches:
            blocks = [libc.malloc(4096) for _ in range(20_000)]
            for x in blocks:
                ctypes.memset(x, 1, 4096)
            pins.append(libc.malloc(4096))  # above the blocks: the library gives back only what is free at the top
            for x in blocks:
                libc.free(x)
            yield b

    batch = pa.record_batch({"x": [1, 2]})
    before = held()
    plain = list(run(iter([batch])))
    kept = held() - before
    assert list(C.gives_back(run)(iter([batch]))) == plain and kept > 60 and held() - before < 20
    for x in pins:
        libc.free(x)


def test_likelihoods_are_sums_over_the_table():
    import pyarrow as pa

    grams = np.sort(np.array([int.from_bytes(x, "big") for x in (b"\0\0\0\0bad ", b"\0\0\0\0\0bad", b"\0\0\0\0\0\0\0o")], np.uint64))
    m = toxicity.Model(grams, np.arange(1, 4, dtype=np.float32), np.arange(4, 7, dtype=np.float32))
    value = dict(zip(grams.tolist(), range(3), strict=True))
    texts = ["Bad bad good", "", None, "of o"]
    got = toxicity.text_likelihoods(m, pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        w, total = (t or "").lower().split(), np.zeros(2)
        for x in w:
            b = bytes(7) + x.encode() + b" "
            for k in range(len(b) - 7):
                i = value.get(int.from_bytes(b[k : k + 8], "big"))
                total += 0 if i is None else (m.toxic[i], m.ordinary[i])
        assert np.allclose(row, total / max(1, len(w)))


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_recall_with_lists_skipped(spark, tmp_path, kind, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from strandlake.llm import ann

    rng, n = np.random.default_rng(8), 12_000
    x = rng.normal(size=(n, 64)) if kind == "spread" else rng.normal(size=(80, 64))[rng.integers(0, 80, n)] + 0.3 * rng.normal(size=(n, 64))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), tmp_path / "v.parquet", row_group_size=2000)
    chosen, real = [], ann.probes_for
    monkeypatch.setattr(ann, "probes_for", lambda h, c, t: chosen.append((real(h, c, t), len(c))) or chosen[-1][0])
    got = defaultdict(set)
    for r in ann.search(spark.read.parquet(str(tmp_path)), F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert hit >= 0.95 * n / 10
    probes, lists = chosen[0]
    assert probes <= (0.8 if kind == "spread" else 0.1) * lists


def test_scan_keeps_every_neighbour_within_a_carried_bound():
    from strandlake.llm import ann

    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(500, 40)), rng.normal(size=(30, 40))
    d = ((q[:, None] - v[None]) ** 2).sum(2)
    tenth = np.sort(d, axis=1)[:, 9]
    i, k = ann.scan(q, v, 10, tenth * 1.0001)
    found = set(zip(i.tolist(), k.tolist(), strict=True))
    true = {(a, b) for a in range(30) for b in np.flatnonzero(d[a] <= tenth[a]).tolist()}
    assert len(true & found) >= 0.99 * len(true) and all(d[a, b] <= tenth[a] * 1.001 for a, b in found)
    assert len(ann.scan(q, v[:5], 10)[0]) == 150 and len(ann.scan(q[:0], v, 10)[0]) == 0


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_automaton(texts, held):
    """log10 probabilities by walking dictionaries of states, arcs and failure arcs; texts: lists of words with an end."""
    from strandlake.llm import lm

    c1, c2, c3 = Counter(), Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            c1.update(t)
            s = ["<s>", *t]
            c1["<s>"] += 1
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
    starts = c1.pop("<s>", 0)
    n, v = sum(c1.values()), len(c1)
    visits = {**c1, "<s>": starts}
    p1 = lambda w: (c1[w] + lm.ADD) / (n + lm.ADD * (v + 1))
    p2 = lambda a, w: (c2[a, w] + lm.PAIR * p1(w)) / (visits.get(a, 0) + lm.PAIR)
    arcs = {((a,), w): (math.log10(p2(a, w)), (a, w)) for a, w in c2}
    arcs |= {((a, b), w): (math.log10((k + lm.TRIPLE * p2(b, w)) / (c2[a, b] + lm.TRIPLE)), (b, w)) for (a, b, w), k in c3.items()}
    fail = lambda s: math.log10(lm.PAIR / (visits.get(s[0], 0) + lm.PAIR)) if len(s) == 1 else math.log10(lm.TRIPLE / (c2[s] + lm.TRIPLE))
    out = []
    for t in texts:
        state, score = ("<s>",), 0.0
        for w in t:
            while state and (state, w) not in arcs:
                score += fail(state)
                state = state[1:]
            if state:
                x, state = arcs[state, w]
            else:
                x, state = math.log10(p1(w)), (w,) if c1[w] else ()
            score += x
        out.append((len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), score))
    return out


def test_language_model(spark, monkeypatch):
    import re
    import zlib

    from strandlake.llm import lm

    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(lm, "SHARD_CHARS", 4_000)
    rows = [(k, sentence(k, 5 + 7 * k, WORDS + [f"v{j}" for j in range(60)])) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "Only The UNSEEN zzz qqq the of"), (104, rows[40][1]), (105, " ".join(f"w{k % 97}x{k % 13}" for k in range(20_000))), (106, "the"), (106, "the"), (None, rows[3][1])]
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None] for _, t in rows]
    held = [k is None or zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    want = Counter((k, h, *(round(x, 6) for x in r)) for (k, _), h, r in zip(rows, held, brute_automaton(texts, held), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "score": F.lit("mine")})
    for lanes in (1024, 3):
        monkeypatch.setattr(lm, "LANES", lanes)
        got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs.repartition(3)).collect())
        assert got == want
    assert lm.score(docs.limit(0)).count() == 0
    none = lm.score(docs, held_out=F.lit(True)).first()
    assert none["train_tokens"] == 0 and none["n_known"] == 0


def test_questions_leave_the_disk_before_replies_are_shuffled(spark, monkeypatch):
    import os
    import time

    from strandlake.llm import lm

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f: os.path.getsize(f) for f in files if "/shuffle_" in f and f.endswith(".data") and os.path.exists(f)}

    monkeypatch.setattr(lm, "BLOCK_TOKENS", 5_000)
    monkeypatch.setattr(lm, "SHARD_CHARS", 40_000)
    docs = spark.createDataFrame([(k, sentence(k, 400, [f"v{j}" for j in range(3_000)])) for k in range(100)], "doc_id long, text string")
    left, real = {}, C.materialize

    def materialize(df, name, *rest):
        before, out, end = set(shuffled()), real(df, name, *rest), time.time() + 2
        size = lambda: sum(n for f, n in shuffled().items() if f not in before)
        while size() > 50_000 and time.time() < end:
            time.sleep(0.1)
        left[name] = size()
        return out

    monkeypatch.setattr(C, "materialize", materialize)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    assert lm.score(docs).count() == 100
    assert left["lm-counts"] <= 50_000 and spark.conf.get(key) == old


def test_automaton_sums_to_one():
    from strandlake.llm import lm

    tokens = np.array([11, 12, 11, 13, 12, 11, 12, 13, 14], np.uint64) * np.uint64(1 << 20)
    b = lm.Block(tokens, np.array([9]), np.array([False]))
    counts = dict(zip(b.keys.tolist(), b.training_counts().tolist(), strict=True))
    word = [c for k, c in counts.items() if k & 3 == 1]
    n, v = sum(word), len(word)

    def score(text):
        x = lm.Block(np.array(text, np.uint64) * np.uint64(1 << 20), np.array([len(text)]), np.array([True]))
        return x.scores(np.array([counts.get(k, 0) for k in x.keys.tolist()]), n, v)["score"][0]

    for before in ([11, 12], [12], [13, 13], [99], [99, 11]):
        assert math.isclose(sum(10 ** (score([*before, w]) - score(before)) for w in (11, 12, 13, 14, 98)), 1.0, rel_tol=1e-9)


def test_lanes_do_not_matter(monkeypatch):
    from strandlake.llm import lm

    rng = np.random.default_rng(2)
    lengths = np.array([1, 40, 2, 1, 300, 7])
    b = lm.Block(rng.integers(1, 9, lengths.sum()).astype(np.uint64) * np.uint64(1 << 20), lengths, np.zeros(6, bool))
    counts = b.training_counts() - (rng.random(len(b.keys)) < 0.3)
    got = []
    for lanes in (1, 3, 50, 1024):
        monkeypatch.setattr(lm, "LANES", lanes)
        got.append(b.scores(np.maximum(counts, 0), 351, 8)["score"])
    assert all(np.allclose(g, got[0]) for g in got)


def test_warc_of_no_pages_and_of_long_streams(spark, tmp_path):
    import gzip

    from strandlake.llm import warc

    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, f"{tmp_path}/none/whole")
    assert warc.normalise(spark, f"{tmp_path}/none/whole", f"{tmp_path}/none/members").count() == 0
    assert warc.read_records(spark, f"{tmp_path}/none/members").count() == 0
    # One stream over members and reads that cut records anywhere.
    records = [warc.record_bytes(k, "u", "response", "x", 50_000, None, bytes([k % 251]) * 50_000) for k in range(60)]
    whole = b"".join(records)
    for pieces in ([gzip.compress(whole)], [gzip.compress(whole[:77_777]) + gzip.compress(whole[77_777:])]):
        data = pieces[0]
        cuts = [data[a : a + 1013] for a in range(0, len(data), 1013)]
        splitter = warc.RecordSplitter()
        assert [r for x in warc.inflate(cuts, 4096) for r in splitter.feed(x)] == records and not splitter.rest
        with pytest.raises(ValueError):
            list(warc.inflate([data[:-9]]))
    assert list(warc.inflate([])) == []


def test_alias_sql_follows_chains(spark, tmp_path):
    import duckdb

    from strandlake.llm import urls

    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.org/1#x", link("http://B.org/2")), (2, "http://b.org/2", link("http://c.example.com/en/3")), (3, "http://d.org/", link("http://e.org/")), (4, "http://f.org/", link("http://www.example.com/en/9")), (5, "http://g.org/", link("http://f.org/") + link("http://q.net/fr/1")), (6, None, link("http://q.net/fr/1")), (7, "http://q.net/fr/1", ""), (8, "http://h.org/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = urls.op9_url_filter(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({urls.SQL['op9_url_filter']})").fetchall(), key=repr)
    got = {r["page_id"]: r["verdict"] for r in urls.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
