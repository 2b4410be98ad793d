"""Signature joins lose no pair, at any cutoff."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.operators import similarity


@settings(max_examples=400, deadline=None)
@given(st.text("ACDE", min_size=1, max_size=14), st.text("ACDE", min_size=1, max_size=14), st.sampled_from([55.0, 60.0, 75.0, 85.0, 92.5, 100.0]))
def test_similar_strings_share_a_key(a, b, cutoff):
    if similarity.indel_ratio(a, b) >= cutoff:
        a, b = sorted((a, b), key=len)
        assert {*similarity.signatures(a, cutoff, True)} & {*similarity.signatures(b, cutoff, False)}


@settings(max_examples=200, deadline=None)
@given(st.text("ACDEFGH", min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 29), st.sampled_from(["", "A", "CC"])), max_size=6), st.sampled_from([60.0, 75.0, 90.0]))
def test_edited_strings_share_a_key(a, edits, cutoff):
    b = list(a)
    for at, new in edits:
        if at < len(b):
            b[at] = new
    b = "".join(b)
    if b and similarity.indel_ratio(a, b) >= cutoff:
        a, b = sorted((a, b), key=len)
        assert {*similarity.signatures(a, cutoff, True)} & {*similarity.signatures(b, cutoff, False)}


@pytest.mark.parametrize("cutoff", [60.0, 85.0])
def test_joins(spark, cutoff):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("ACDEFG"), rng.integers(1, 16))) for _ in range(60)]
    words = list(dict.fromkeys(base + [w[: len(w) // 2] + "K" + w[len(w) // 2 :] for w in base] + [w[1:] for w in base if len(w) > 1] + ["", "X" * 70, "X" * 72]))
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)] + [(10_000, None)], "row_idx long, sequence string")
    got = {(r["l_idx"], r["r_idx"]): r["ratio"] for r in similarity.signature_join(rows, cutoff=cutoff).collect()}
    want = {(i, j): similarity.indel_ratio(a, b) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and a and b and similarity.indel_ratio(a, b) >= cutoff}
    assert len(want) > 50 and got == want
    l, r = rows.where("row_idx % 3 = 0"), rows.where("row_idx % 3 != 0")
    two = [(x["l_idx"], x["r_idx"]) for x in similarity.signature_join(l, r, cutoff).collect()]
    assert len(two) == len({*two}) and {*two} == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i % 3 == 0 and j % 3 and a and b and similarity.indel_ratio(a, b) >= cutoff}
    assert similarity.signature_join(rows.limit(0)).count() == 0


def _meet(left, right, cutoff, equal=True):
    """Pairs of a shorter and a longer string that share a key, and how often pairs meet under keys."""
    under = {}
    for b in right:
        for key in similarity.signatures(b, cutoff, False, equal):
            under.setdefault(key, []).append(b)
    met = [(a, b) for a in left for key in similarity.signatures(a, cutoff, True, equal) for b in under.get(key, ()) if len(a) <= len(b)]
    return {*met}, len(met)


def test_words_of_a_common_half_meet_only_if_similar():
    rng = np.random.default_rng(4)
    ends = {"".join(rng.choice(list("ACDEFGHIKL"), 5)) for _ in range(400)}
    short = sorted({"ACDEF" + w for w in ends} | {w + "ACDEF" for w in ends})
    longer = sorted({w[:7] + "Y" + w[7:] for w in short[::5]} | {w + "W" for w in short[1::5]} | {"ACDEF" + w[5:] + "AC"[k % 2] for k, w in enumerate(short[2::3])})
    met, times = _meet(short, longer, 92.5)
    want = {(a, b) for a in short for b in longer if similarity.indel_ratio(a, b) >= 92.5}
    assert len(want) > 200 and met == want
    assert times == len(want)


@pytest.mark.parametrize("cutoff", [75.0, 92.5])
def test_subsequences_and_parts_lose_no_pair(monkeypatch, cutoff):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ACDE"), n)) for n in (1, 2, 3, 9, 14, 15, 20, 24, 27, 31, 45, 60)]
    for w in words[:]:
        for edits in (1, 2, 3, 4):
            own = list(w)
            for _ in range(edits):
                at = rng.integers(0, len(own) + 1)
                own[at : at + rng.integers(0, 2)] = rng.choice(list("ACDEÄ😀"), rng.integers(0, 2))
            words.append("".join(own))
    words = [*dict.fromkeys(w for w in words if w)]
    want = {(a, b) for a in words for b in words if len(a) <= len(b) and similarity.indel_ratio(a, b) >= cutoff}
    for most in (0, 20, 256, 3000):
        monkeypatch.setattr(similarity, "SUBSEQUENCES", most)
        assert want <= _meet(words, words, cutoff)[0]


def test_a_string_has_each_key_once():
    for s in ("A" * 14, "ACACACACACACACAC", "A" * 40):
        for as_shorter in (True, False):
            keys = similarity.signatures(s, 92.5, as_shorter)
            assert len(keys) == len({*keys})
