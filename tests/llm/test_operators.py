"""Every corpus operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import _common as C
from strandlake.llm import ann, bpe, components, html_extract, lm, neardup, packing, quality, toxicity, urls, warc

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
BASE = "the quick brown fox of the woods jumps over a lazy dog and runs to the river for water in the morning light".split()


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(BASE * 5 + [f"v{k}" for k in range(200)], n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, sentence(1, 80)), (2, None), (3, ""), (4, " \n\t "), (5, "One two"), (6, LONG), (7, sentence(1, 80)), (8, sentence(1, 80) + " tail"), (9, "a b c\na b c\n\na b c"), (10, "naïve ### $$$ 😀 it's <|endoftext|> done"), (11, sentence(2, 60)), (11, sentence(2, 60))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("mine"), "key": F.lit(1), "n": F.lit(2), "predicted": F.lit(0), "kept": F.lit("x")})


def words(t):
    return WORD.findall(t or "")


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (None, 4), (9, 8), (8, 9), (3, 1)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 140)} | {k: 200 for k in range(200, 231)}
    assert components.connected_components(e.limit(0)).count() == 0


def brute_quality(t):
    w = words(t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(tri)
    covered = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs):
    got = sorted(map(tuple, quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept").collect()))
    want = sorted((d, *brute_quality(t)) for d, t in ((r["doc_id"], r["text"]) for r in docs.collect()))
    assert [g[:6] for g in got] == want
    assert {g[0] for g in got if g[6]} == {1, 7, 8, 11}
    assert quality.judge(docs.limit(0)).count() == 0


def test_bpe_matches_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = bpe.round_trip(docs).collect()
    assert len(got) == 12
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in docs.collect())


def brute_links(rows):
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(FOLD))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(seed, text, rate):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > rate else f"e{rng.integers(1000)}" for w in text.split())


def test_near_duplicates(spark, docs):
    base = sentence(5, 150)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + k, edited(k, base, 0.02 + 0.002 * k)) for k in range(25)] + [(200 + k, " ".join(base.split()[: 8 + k])) for k in range(6)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))).collect()}
    assert got == brute_links(rows)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.near_duplicates(docs.where("doc_id IN (2, 3)")).where("kept").count() == 2


def test_sketches_estimate():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.75, 0.95):
        for n in (40, 3000):
            common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, (n - len(common)) // 2, dtype=np.uint64)])) for _ in range(2))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = neardup.sketches([a, b])
            assert abs(neardup.estimate(s[:1], s[1:])[0] - j) < (0.25 if n == 40 else 0.1)


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    pieces = packing.pack(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.update((r["doc_id"], k, x) for k, x in enumerate(ids))
    got, at = Counter(), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u2")
        assert len(ids) == p["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == p["ids_crc32"]
        got.update((p["doc_id"], p["start"] + k, int(x)) for k, x in enumerate(ids))
        at[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_retrieval_prefers_like_tails():
    rng = np.random.default_rng(2)
    topics = [rng.integers(0, 50_000, 30, dtype=np.uint16) for _ in range(2)]
    tails = [(k, 0, 120, np.tile(topics[k % 2], 4)) for k in range(12)]
    shard = packing.Shard(tails)
    shard.free[0] = False
    assert {int(x) % 2 for x in shard.like(0)[:5]} == {0}


def test_toxicity_learns_rare_forms(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(600):
        w = sentence(k, 60).split()
        if k % 3 == 0:
            for j in rng.integers(0, 60, 4):
                w[j] = "grumpf" + rng.choice(["ing", "ed", "s", "y", "ly", "er"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 3 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "Grumpfest grumpfs and grumpfish words"), (1002, "Grumpfest grumpfs and grumpfish words"), (1003, LONG)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    l = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.train(d, l)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) > 0.95 * len(held)
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] >= 1000} == {1000: 0, 1001: 0, 1002: 1, 1003: 0}
    assert toxicity.score(d, toxicity.train(d, l.limit(0))).count() == len(rows)
    assert toxicity.score(d.limit(0), toxicity.train(d, l)).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<html><head><link href="{}" rel=canonical></head></html>'
    rows = [(1, "https://WWW.Example.com/en/x?q#f", None), (2, "http://a.example.com/en/1", ""), (3, "http://x.org/p", link.format("http://a.example.com/en/1")), (4, "http://y.org/p#z", link.format("http://x.org/p")), (5, None, link.format("http://a.example.com/en/1")), (6, "no scheme", None), (7, "http://q.net/fr/1", None), (8, "http://z.org/", '<meta http-equiv="refresh" content="0; url=http://q.net/fr/1"><link rel="canonical" href="http://good.com/">'), (9, "ftp://notnet/fr/", None), (9, "ftp://notnet/fr/", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "component": F.lit(1)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(d).collect()}
    assert got == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/1", "example.com/en/", "block"), 3: ("x.org", "/p", None, "block"), 4: ("y.org", "/p", None, "block"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("q.net", "/fr/1", "net/fr/", "block"), 8: ("z.org", "/", None, "allow"), 9: ("notnet", "/fr/", None, "allow"),
    }
    r = spark.createDataFrame([("http://w.org/", "http://q.net/fr/1"), (None, "http://q.net/")], "from_url string, to_url string")
    assert urls.judge(d.limit(1).select(F.lit(1).alias("page_id"), F.lit("http://w.org/").alias("url"), F.lit("").alias("html")), redirects=r).first()["verdict"] == "block"
    assert urls.judge(d.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/ x", ""), (5, "http://e/", "é" * 500_000), (6, "http://f/", "x\r\n\r\ny Content-Length: 5"), (6, "http://f/", "x\r\n\r\ny Content-Length: 5")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("top", F.lit(3))
    warc.write_archives(d, f"{tmp_path}/whole", archive_bytes=1000)
    index = warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/members")
    assert index.count() == len(rows)
    got = warc.read_records(spark, f"{tmp_path}/members").collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and {k: (r["record_type"], r["refers_to"]) for k, r in by.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert bytes(by[5]["payload"]).decode() == "é" * 500_000 and by[5]["payload_bytes"] == 1_000_000 and by[1]["payload_bytes"] == 4
    assert by[3]["url"] is None and bytes(by[6]["payload"]) == b"x\r\n\r\ny Content-Length: 5" and by[1]["payload"] is None


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[100:500] = x[3]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [1.0, 2.0]), (None, [1.0] * 8), (7, [float(v) for v in x[7]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit(1), "x": F.lit(1), "label": F.lit(1)})
    got = defaultdict(list)
    for r in ann.search(d, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hit = 0
    for q in range(0, 900, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(900), dist)) if k != q][:10]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        assert all(math.isclose(s, dist[k], abs_tol=1e-12) for s, k in got[q])
        hit += len({k for _, k in got[q]} & set(want))
    assert set(got) == set(range(0, 900, 100)) and hit >= 0.9 * 90
    assert ann.search(d.limit(0), F.col("vec_id") == 0).count() == 0
    few = ann.search(d.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3


def test_html_blocks_and_labels(spark):
    t = "<html><head><title>T</title><style>x{}</style></head><body><nav><a href=a>Menu</a></nav><article><h1>Head &amp; more</h1><p>One <b>bold</b>\n text<p>Two<br>lines<script>var a='</p>'</script></article><!-- <p>gone</p> --><div class='comments'><p>me first</p></div><footer>&copy; foot"
    blocks = html_extract.blocks_of(t)
    assert [b[0] for b in blocks] == ["Menu", "Head & more", "One bold text", "Two lines", "me first", "© foot"]
    assert html_extract.weak_labels(blocks) == [0, 1, 1, 1, 0, 0]
    rows = [(k, f"http://h/{k}", t.replace("Two", sentence(k, 20))) for k in range(40)] + [(100, None, None), (101, "u", ""), (102, "u", "<"), (102, "u", "<")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "n_chars": F.lit("x")})
    model = html_extract.train(d)
    got = html_extract.extract(d, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] < 40:
            assert r["text"] == f"Head & more\nOne bold text\n{sentence(r['page_id'], 20)} lines" and r["n_chars"] == len(r["text"])
        elif r["page_id"] < 102:
            assert r["text"] == "" and r["n_chars"] == 0
    assert html_extract.extract(d.limit(0), model).count() == 0


def test_scratch_tables_can_go(spark):
    t = C.materialize(spark.range(5), "t")
    assert t.count() == 5
    C.discard(t)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t._scratch_path).count()
