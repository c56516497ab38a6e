"""Series from a stream: buckets leave once the watermark has passed, and forecasts follow the state of their series."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import live


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_buckets_and_forecasts(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a" if m < 30 else "b", float(h)) for h in range(8) for m in (5, 25, 45)]
    events = spark.createDataFrame(rows, "ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):  # two files, two batches
        events.filter(F.hour("ts") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    buckets = live.bucketed_stream(stream, "ts", "1 hour", "10 minutes", F.sum("v"), "kind")
    got = {(r["series_id"], r["ts"].hour): r["y"] for r in drain(buckets, "buckets").collect()}
    # the last hour is still within the watermark
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", h): 2.0 * h for h in range(7)}
    assert {h for s, h in got if s == "b"} == set(range(7))
    # closed buckets are a table of their own, which the forecasts follow as a stream
    spark.table("buckets").coalesce(1).write.parquet(str(tmp_path / "closed"))
    closed = spark.readStream.schema("series_id string, ts timestamp, y double").parquet(str(tmp_path / "closed"))
    ahead = drain(live.forecast_buckets(closed, {"a": [1.0, 0.5, 0.25]}), "ahead").collect()
    a = {r["ts"].hour: r["y_next"] for r in ahead if r["series_id"] == "a"}
    assert a[0] is None and a[3] == pytest.approx(1 + 0.5 * 4 + 0.25 * 6)
    assert all(r["y_next"] is None for r in ahead if r["series_id"] == "b")
