"""The pipeline's stages one after the other, and that every query is registered."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import queries

WORDS = "the of and to in is that for it as was with".split() + [f"term{k}" for k in range(300)]


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(300):
        w = list(rng.choice(WORDS[:12], 40)) + list(rng.choice(WORDS, 60))
        rng.shuffle(w)
        if k % 4 == 0:
            for j in rng.integers(0, 100, 6):
                w[j] = "vilest" + str(rng.integers(3))
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(400, rows[1][1], "en", "s", 0), (401, rows[1][1] + " end", "en", "s", 0), (402, None, None, None, None), (403, "### " * 80, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs = corpus_pipeline.C.materialize(docs, name)
        ids.append({r[0] for r in docs.select("doc_id").collect()})
    assert not {k for k in ids[0] if k < 300 and k % 4 == 0} and {k for k in range(300) if k % 4} <= ids[0]
    assert not {402, 403} & ids[1] and {400, 401} <= ids[1]
    assert ids[2] == ids[1] - {400, 401}
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == ids[2]
    assert last.agg(F.sum("length")).first()[0] == last.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_first_stage_writes_fewer_files(spark, tmp_path):
    from strandlake.llm import toxicity

    text = lambda k: " ".join(WORDS[(k * j) % 100] for j in range(60)) + (" vilest" if k % 4 == 0 else "")
    rows = [(k, text(k), "en", "s", 0) for k in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        most = max(docs.rdd.getNumPartitions() // 3, 2 * spark.sparkContext.defaultParallelism)
        out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
        assert docs.rdd.getNumPartitions() == 40 and out.rdd.getNumPartitions() <= most < 40
        model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
        whole = toxicity.score(docs, model).where("predicted = 0").select(docs.columns)
        got, want = (sorted(map(tuple, df.collect())) for df in (out, whole))
        assert got == want and 0 < len(got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == [*range(1, 14)] and set(queries.SQL) <= set(queries.QUERIES)
