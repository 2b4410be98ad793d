"""Scores that arrive as a stream: validation, confidence and decisions of each row, and running confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import logit, valid


def decide(stream: DataFrame, score: str = "score", sequence: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Append logit, confidence and prediction; rows with an invalid sequence or score are left out."""
    rows = stream.where(F.col(score).between(0, 1))
    if sequence:
        rows = rows.where(valid(F.col(sequence)))
    return rows.withColumns({"logit": logit(F.col(score)), "confidence": 2 * F.abs(F.col(score) - 0.5), "prediction": (F.col(score) >= threshold).cast("int")})


def running_confusion(stream: DataFrame, keys: list[str], label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn and fn of every value of keys so far, for complete or update output."""
    hit, y = F.col(score) >= threshold, F.col(label)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return decide(stream, score).groupBy(*keys).agg(count(hit & (y == 1)).alias("tp"), count(hit & (y == 0)).alias("fp"), count(~hit & (y == 0)).alias("tn"), count(~hit & (y == 1)).alias("fn"))
