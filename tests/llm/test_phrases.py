"""Phrases and counting quotient filters against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import phrases, quotient

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(100 * f[q] >= 50 * a for q in longer(f, lang, p, least)):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    ranked, seen = [], Counter()
    for lang, score, a, p, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, l, r, n[lang], -score))
    return ranked


_longer = {}


def longer(f, lang, p, least):
    if id(f) not in _longer:
        _longer.clear()
        table = _longer[id(f)] = {}
        for (g, q), a in f.items():
            if len(q) == 3 and a >= least:
                for part in (q[:2], q[1:]):
                    table.setdefault((g, part), []).append((g, q))
    return _longer[id(f)].get((lang, p), [])


def table():
    rng = np.random.default_rng(5)
    base = ["new", "York", "city", "Été", "漢字", "of", "the", "a", "b", "ö", "zz"] + [f"w{k}" for k in range(40)]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ";x "]
    rows = []
    for k in range(900):
        words = rng.choice(base, rng.integers(1, 60), p=np.array([8] * 11 + [1] * 40) / 128)
        rows.append((["en", "de", None, "und"][k % 4], "".join(w + str(rng.choice(ends)) for w in words)))
    rows += [("en", "new york city. " * 30), ("de", "a a a a a a a a a a a a a " * 20), ("fr", None), ("fr", ""), ("fr", "one two"), ("es", "x" * 100_000 + " y"), (None, None), ("en", " rare%d once%d" % (1, 2))]
    return rows


@pytest.mark.parametrize("one_read, block", [(400_000, 1_000_000), (12, 500), (0, 100)])
def test_phrases(spark, monkeypatch, one_read, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = table()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit("mine"), "word": F.lit(1), "id": F.lit(2), "range": F.lit(3)})
    got = phrases.phrases(docs, one_read=one_read)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_top_and_no_rows(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.phrases(docs, top=7, least=12).collect())) == brute(rows, 12, 7)
    assert phrases.phrases(docs.limit(0)).count() == 0 and phrases.phrases(docs.where("text IS NULL")).count() == 0


@pytest.mark.parametrize("w", [2, 5, 17, 21, 22, 31])
def test_filters_lose_nothing(w):
    rng = np.random.default_rng(w)
    n = min(5000, 1 << (2 * w))
    left = rng.integers(0, 1 << (2 * w), n, dtype=np.uint64)
    right = rng.integers(0, 1 << w, n, dtype=np.uint64)
    left[: n // 3], right[: n // 3] = left[0], right[0]
    x, y = quotient.permute(left, right, w)
    back = quotient.restore(x, y, w)
    assert (back[0] == left).all() and (back[1] == right).all() and x.max() < 1 << (2 * w) and y.max() < 1 << w
    want = Counter(zip(left.tolist(), right.tolist(), strict=True))
    prefix = min(4, 2 * w - 1)
    for big in (1, 1000, 1 << 40):
        total: Counter = Counter()
        a, b, c = quotient.sorted_counts(x, y, w)
        part = a >> np.uint64(2 * w - prefix)
        for r in np.unique(part):
            own = part == r
            data = quotient.encode(a[own], b[own], c[own] * big, w, prefix)
            p, q, k = quotient.decode(data, w, prefix, int(r))
            assert (p == a[own]).all() and (q == b[own]).all()
            p, q, k = quotient.sorted_counts(np.concatenate([p, p[:3]]), np.concatenate([q, q[:3]]), w, np.concatenate([k, np.zeros(min(3, len(k)), np.int64)]))
            l, m = quotient.restore(p, q, w)
            total.update(dict(zip(zip(l.tolist(), m.tolist(), strict=True), k.tolist(), strict=True)))
        assert total == {k: v * big for k, v in want.items()}
    none = quotient.encode(*(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64), w, prefix)
    assert len(quotient.decode(none, w, prefix, 0)[0]) == 0


def test_query_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{d}/documents.parquet'")
    assert sorted(map(tuple, phrases.op11_phrases(spark, d).collect())) == sorted(con.sql(phrases.SQL["op11_phrases"]).fetchall())
