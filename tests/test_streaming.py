from strandlake.streaming import scores


def test_running_confusion(spark, tmp_path):
    rows = [("a", 1, 0.9), ("a", 0, 0.8), ("b", 0, 0.1), ("b", 1, 0.2), ("b", 1, None), ("b", 1, 1.5)]
    spark.createDataFrame(rows, "k string, label int, score double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, label int, score double").parquet(f"{tmp_path}/in")
    q = scores.running_confusion(stream, ["k"]).writeStream.format("memory").queryName("confusion").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["k"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in spark.table("confusion").collect()} == {"a": (1, 1, 0, 0), "b": (0, 0, 1, 1)}
