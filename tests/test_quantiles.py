"""Quantiles by narrowing and wide vectors against brute force."""

import numpy as np
import pytest

from strandlake.functions.sequence import RESIDUES
from strandlake.operators import features
from strandlake.operators.quantiles import quantiles


@pytest.mark.parametrize("parts, few", [(4, 3), (1024, 10_000)])
def test_quantiles(spark, parts, few):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=300), "b": np.repeat([1.0, 2.0], 40), "c": np.array([5.0]), None: np.exp(rng.normal(size=90) * 30), "e": np.array([-1e308, 1e308, 0.0, 0.0, 3.5])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("none", None)]
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, parts, few).collect()}
    assert {*got} == {(k, s) for k in groups for s in shares}
    for (k, s), x in got.items():
        if k != "e" or s in (0.0, 0.5, 1.0):
            assert x == pytest.approx(np.percentile(groups[k], 100 * s), rel=1e-9)
    none = spark.createDataFrame(rows, "g string, v double").limit(0)
    assert quantiles(none, ["g"], "v", shares).count() == 0
    with pytest.raises(Exception, match="infinite"):
        quantiles(spark.createDataFrame([("a", float("inf"))], "g string, v double"), ["g"], "v", shares)


def test_wide_vectors(spark):
    texts = {1: "ACAC", 2: "A", 3: "", 4: None, 5: "WWWWY"}
    rows = spark.createDataFrame([(k, t, "mine") for k, t in texts.items()], "row_idx long, sequence string, aac string")
    for r in features.handcrafted(rows).withColumn("v", features.vector()).collect():
        t = texts[r["row_idx"]] or ""
        want = [t.count(x) / max(1, len(t)) for x in RESIDUES] + [sum(t[i : i + 2] == p for i in range(len(t) - 1)) / max(1, len(t) - 1) for p in features.PAIRS] + [len(t)]
        assert r["v"] == pytest.approx(want) and len(want) == 421
