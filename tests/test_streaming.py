"""Sliding windows on a stream give what the same windows give on the whole."""

import datetime

from tidewave.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 2, start + datetime.timedelta(seconds=7 * i), float(i)) for i in range(60)]
    table = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    found = windows.sliding_means(stream, "user_id", "ts", "value", "60 seconds", "30 seconds", "10 minutes")
    query = found.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(spark.table("found").collect(), key=key) == sorted(windows.sliding_means(table, "user_id", "ts", "value", "60 seconds", "30 seconds", "10 minutes").collect(), key=key)
    assert spark.table("found").count() > 20
