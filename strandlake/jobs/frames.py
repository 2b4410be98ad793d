"""The driver's tables as labelled, scored and sequence frames: whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import LOWER, RESIDUES, UPPER, residues_of, unit_hash, word_list


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floor2(x):
    return F.floor(x * 100) / 100


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, split, label, toxic, lang, source, length, weight, score, rival): every document with two scores."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), (F.col("doc_id") % 5).alias("split"), "lang", "source", F.length("text").alias("length"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_idx"), F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("toxic"))
    out = d.join(l, "row_idx", "left")
    y = F.coalesce(F.col("label").cast("double"), F.lit(0.5))
    return out.withColumns({
        "score": floor2(unit_hash(F.lit("s"), "row_idx") * 0.7 + y * 0.3),
        "rival": floor2(unit_hash(F.lit("t"), "row_idx") * 0.8 + y * 0.2),
        "weight": floor2(unit_hash(F.lit("w"), "row_idx")) + 0.5,
    })


SCORED = """d AS (SELECT doc_id AS row_idx, doc_id % 5 AS split, lang, source, length(text) AS length, quality::INT AS label, toxic::INT AS toxic,
    floor((('0x' || substr(md5('s|' || doc_id), 1, 8))::BIGINT / 4294967296.0 * 0.7 + coalesce(quality::DOUBLE, 0.5) * 0.3) * 100) / 100 AS score,
    floor((('0x' || substr(md5('t|' || doc_id), 1, 8))::BIGINT / 4294967296.0 * 0.8 + coalesce(quality::DOUBLE, 0.5) * 0.2) * 100) / 100 AS rival,
    floor(('0x' || substr(md5('w|' || doc_id), 1, 8))::BIGINT / 4294967296.0 * 100) / 100 + 0.5 AS weight
    FROM documents LEFT JOIN labels USING (doc_id))"""


def raw_words(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(key, pos, word): every word of every whole text."""
    return table(spark, sf_dir, name).select(key, F.posexplode(word_list(F.col("text"))).alias("pos", "word"))


def words(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """raw_words() with sequence, their residue letters in upper case."""
    return raw_words(spark, sf_dir, name, key).withColumn("sequence", residues_of(F.col("word")))


def words_sql(name: str = "documents", key: str = "doc_id") -> str:
    return rf"""w AS (SELECT {key}, i - 1 AS pos, ws[i] AS word, regexp_replace(translate(ws[i], '{LOWER}', '{UPPER}'), '[^{RESIDUES}]', '', 'g') AS sequence
    FROM (SELECT {key}, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {key}, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {name})))"""
