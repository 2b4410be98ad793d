"""Corpus operators over everything that they are given."""

from collections import Counter

import corpus_pipeline
from strandlake.llm import neardup, urls


def test_aliases_of_every_kind(spark):
    at, bad = "http://a.org/x/p?q=1", "http://q.net/fr/"
    pages = {
        '<link rel="canonical" href="page.html">': ["http://a.org/x/page.html"],
        "<link rel=canonical href=../y>": ["http://a.org/y"],
        '<link rel="canonical" href="?id=1&amp;b=&#50;">': ["http://a.org/x/p?id=1&b=2"],
        "<META HTTP-EQUIV=refresh CONTENT='5;URL=next.html'>": ["http://a.org/x/next.html"],
        '<link rel="shortlink canonical" href="//B.org/z">': ["http://B.org/z"],
        f"<meta http-equiv=\"refresh\" content=\"0;url='{bad}'\">": [bad],
        f'<link rel=canonical href="/1"><meta http-equiv=refresh content="0; url={bad}"><link href=/2 rel=canonical>': ["http://a.org/1", bad, "http://a.org/2"],
        '<base href="/k/"><link rel=canonical href=m>': ["http://a.org/k/m"],
        '<!-- <link rel=canonical href="/1"> --><script>"<link rel=canonical href=/2>"</script><link rel=canonical href=mailto:x><link rel=alternate href=/3><meta content="0;url=/4"><link rel=canonical href>': [],
        '<link title="a > b" rel=canonical href="/t">': ["http://a.org/t"],
    }
    for page, want in pages.items():
        assert urls.aliases(at, page) == want
    rows = [(1, "http://a.org/x/p", '<link rel="shortlink canonical" href="../b">'), (2, "http://a.org/b", f"<meta http-equiv=refresh content=\"0;url='{bad}'\">"), (3, "http://c.org/", "<link rel=canonical href=/d><link rel=canonical href=//q.net/es/1>")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "block"}


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (2, a + " end"), (None, a), (3, b), (3, c), (4, c), (None, d), (None, d + " end"), (None, None), (5, ""), (5, ""), (6, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    assert Counter((r["doc_id"], r["component_id"]) for r in got if r["kept"] and r["n_shingles"]) == Counter([(1, 1), (3, 3), (4, 4), (None, None), (6, 6)]) and sum(r["kept"] for r in got) == 8
    assert Counter(r["component_id"] for r in got if r["n_shingles"]) == Counter([1] * 4 + [3] + [4] * 2 + [None] * 2 + [6])
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    texts = Counter((r["text"] or "")[:2] for r in left)
    assert texts == {"a0": 1, "b0": 1, "c0": 1, "d0": 1, "al": 1, "": 3} and Counter(r["doc_id"] for r in left) == Counter([1, 3, 4, None, None, 5, 5, 6])
