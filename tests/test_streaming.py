"""The streaming feature table equals the batch one."""

from __future__ import annotations

from pulseframe.streaming import windowed_features

CATALOG = {"value": ("mean", "range", "pct")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02}:00", m % 3, float(m * m % 17)) for m in range(60)]
    table = spark.createDataFrame(rows, "ts string, k long, value double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "k", "value")
    table.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = windowed_features(stream, ["k"], CATALOG, "ts", "10 minutes", "2 hours")
    query = found.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windowed_features(table, ["k"], CATALOG, "ts", "10 minutes", "2 hours").collect()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch)) and len(batch) == 18
