import datetime

from lamina.streaming.term_counts import windowed_counts


def test_windowed_counts(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, docset string, line string"
    spark.createDataFrame([(at(1, 5), "a", "x y x."), (at(1, 50), "a", "x"), (at(2, 10), "a", None), (at(4, 0), "b", "z")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, stop=["."]).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["window"]["start"].hour, r["docset"], r["term"], r["cnt"]) for r in spark.table("counts").collect())
    assert got == [(1, "a", "x", 3), (1, "a", "y", 1), (4, "b", "z", 1)]
