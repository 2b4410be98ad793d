"""The contract of prediction vectors."""

import pytest

from strandlake.operators import audit


def test_contract(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.25, None), (3, 1.0, float("nan")), (4, 0.0, float("inf")), (5, 0.3, -0.5)], "row_idx long, good double, bad double")
    got = {r["model"]: tuple(r)[1:] for r in audit.prediction_counts(rows, ["good", "bad"]).collect()}
    assert got == {"good": (5, 0, 0, 0, 0), "bad": (5, 1, 2, 1, 0)}
    assert audit.require_predictions(rows, ["good"], 5) is rows
    for models, n, table in ((["good"], 6, rows), (["good", "bad"], 5, rows), ([], 5, rows), (["good"], 6, rows.unionByName(rows.limit(1))), (["good"], 1, rows.limit(0))):
        with pytest.raises(ValueError):
            audit.require_predictions(table, models, n)
