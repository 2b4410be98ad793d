"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents.  run() writes every stage's rows as Parquet in the shared scratch folder and rereads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import _common as C
from strandlake.llm import neardup, packing, quality, toxicity


#: Tasks of a scan that one task of the first stage takes, as long as every core still has two.
SCANS = 3


def gathered(docs: DataFrame) -> DataFrame:
    """All rows of docs in fewer tasks: each task of a stage writes a file, and a local disk's every file starts processes."""
    tasks = docs.rdd.getNumPartitions()
    return docs.coalesce(max(tasks // SCANS, 2 * docs.sparkSession.sparkContext.defaultParallelism))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from labelled rows of the stage's input, does not predict as toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(gathered(docs), model).where("predicted = 0").select(docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the whole table of quality rules."""
    return quality.judge(docs).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one of the smallest id.  Documents without words stay."""
    rows, _ = neardup.keyed(docs)
    kept = neardup.linked(rows.select("_key", "text"), id_column="_key").where("kept").select(F.col("doc_id").alias("_key"))
    return rows.join(kept, "_key", "left_semi").select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_windows),
]

#: SQL can express neither the toxicity model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
