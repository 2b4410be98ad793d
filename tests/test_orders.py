"""Orders by their index."""

import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.operators import resample


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", min_size=1, max_size=7), st.integers(1, 40))
def test_every_order_once(text, target):
    every = sorted({"".join(p) for p in itertools.permutations(text)})
    assert [resample.order_at(text, k) for k in range(len(every))] == every
    assert [resample.order_index(x) for x in every] == [*range(len(every))]
    drawn = resample.drawn_orders(text, target, random.Random(1))
    assert len(drawn) == len({*drawn}) == min(target, len(every) - 1) and text not in drawn and {*drawn} <= {*every}


def test_long_texts_and_even_draws():
    text = "ACDEFGHIKL" * 30
    drawn = resample.drawn_orders(text, 10, random.Random(2))
    assert len({*drawn}) == 10 and all(Counter(x) == Counter(text) for x in drawn) and resample.order_at(text, resample.order_index(text)) == text
    seen = Counter(x for k in range(3000) for x in resample.drawn_orders("aabb", 2, random.Random(k)))
    assert len(seen) == 5 and max(seen.values()) < 1.15 * min(seen.values())
    assert resample.drawn_orders("", 5, random.Random(0)) == resample.drawn_orders("zzz", 5, random.Random(0)) == []
