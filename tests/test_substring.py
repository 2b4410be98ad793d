"""Substring joins against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import substring


def tables():
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdé漢 ."))
    texts = ["".join(rng.choice(letters, rng.integers(0, 300))) for _ in range(150)] + ["", None, "x" * 5000, "the quick brown fox jumps over the lazy dog again and again"] * 2
    texts += ["".join(rng.choice(letters, 40_000))]
    needles = ["", None, "zzz", "x" * 100, "quick brown fox jumps over the lazy dog", "nowhere to be found in any of these texts at all"]
    for t in texts:
        for n in (1, 2, 3, 5, 9, 13, 30, 33, 80):
            if t and len(t) > n and rng.random() < 0.4:
                at = rng.integers(0, len(t) - n)
                needles.append(t[at : at + n] + ("!" if rng.random() < 0.3 else ""))
    return texts, needles


@pytest.mark.parametrize("span, one_read", [(1 << 20, 1_000_000), (700, 5)])
def test_pairs(spark, monkeypatch, span, one_read):
    monkeypatch.setattr(substring, "SPAN", span)
    monkeypatch.setattr(substring, "ONE_READ", one_read)
    texts, needles = tables()
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "key long, text string").withColumns({"gram": F.lit(1), "contained": F.lit("mine")})
    n = spark.createDataFrame([(x, 1) for x in needles], "needle string, digest int")
    got = {(bytes(r[0]), r[1]) for r in substring.substring_pairs(t, n, needle="needle").collect()}
    want = {(hashlib.sha256(x.encode()).digest(), y) for x in texts for y in needles if x is not None and y and y in x}
    assert len(want) > 1000 and got == want
    some = [x for x in needles if x and len(x) > 20]
    flags = {r["key"]: r["contained"] for r in substring.contains_any(t, n.where("length(needle) > 20"), needle="needle").collect()}
    assert flags == {k: x is not None and any(y in x for y in some) for k, x in enumerate(texts)}


def test_edges(spark):
    t = spark.createDataFrame([("a",), (None,), ("",)], "text string")
    none = t.limit(0)
    assert sorted(map(str, (r["contained"] for r in substring.contains_any(t, none).collect()))) == ["False"] * 3
    assert [r["contained"] for r in substring.contains_any(t, t.where("text = ''")).orderBy("text").collect()] == [False, True, True]
    assert substring.contains_any(none, t).count() == 0 and substring.substring_pairs(t, none).count() == 0


def test_selected_grams_follow_into_texts():
    rng = np.random.default_rng(0)
    for tier in range(len(substring.TIERS)):
        for _ in range(50):
            size = int(rng.integers(substring.reach(tier), substring.reach(tier) + 60))
            text = rng.integers(97, 100, 400, dtype=np.uint8)
            at = int(rng.integers(0, 400 - size))
            both = np.concatenate([text, text[at : at + size]])
            owner, gram = substring.selected(both, np.array([0, 400]), np.array([400, size]), tier)
            a, b = set(gram[owner == 0].tolist()), set(gram[owner == 1].tolist())
            assert b and b <= a
