"""Streams end with the rows of the batch operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import windows
from mosaiq.streaming.anchored import anchored_counts
from mosaiq.streaming.windows import counts

FOLDER = "/root/testdata/sf0.001"
FAR = pd.Timestamp("2035-01-01")


@pytest.fixture
def parts(spark, tmp_path):
    """Events of some users in five files, one of them with events from before the others', and at last one far ahead."""
    e = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value")).toPandas()
    e = e[e.user_id % 5 == 0].sort_values("ts").reset_index(drop=True)
    cut = [e[k * len(e) // 5 : (k + 1) * len(e) // 5] for k in range(5)]
    cut[0], cut[1] = cut[1], cut[0]  # the first fifth comes late
    cut.append(pd.DataFrame([(-1, FAR, "end", 0.0)], columns=e.columns))
    for k, part in enumerate(cut):
        spark.createDataFrame(part, "user_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    for k in range(len(cut)):
        (f,) = (tmp_path / "in" / f"{k}").glob("part-*")
        (tmp_path / "all").mkdir(exist_ok=True)
        f.rename(tmp_path / "all" / f"{k}.parquet")
        import os

        os.utime(tmp_path / "all" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return e, str(tmp_path / "all"), str(tmp_path)


def drained(spark, query_of, folder, out):
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(folder)
    q = query_of(stream).writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.parquet(f"{out}/out").filter("user_id >= 0")


def test_anchored_windows_end_like_a_batch(spark, parts):
    e, folder, out = parts
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(spark, lambda s: anchored_counts(s, "ts", "user_id", "event_type", 86400, 36000, "30 days"), folder, out)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    points = spark.createDataFrame(e).select("user_id", "event_type", (F.expr("unix_micros(ts)") / 1e6).alias("t"))
    span = points.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    w = windows.slider(span, F.col("t0"), F.col("t1"), F.lit(86400.0), F.lit(36000.0)).select("user_id", "window")
    want = windows.pane_counts(points.join(span.select("user_id", "t0"), "user_id"), "t", "t0", 86400, 36000, "user_id", "event_type").join(w, ["user_id", "window"])
    rows = sorted(map(tuple, want.select("user_id", "window", "event_type", "n").collect()))
    assert len(rows) > 50 and sorted(map(tuple, got.select("user_id", "window", "code", "n").collect())) == rows


def test_aligned_windows_end_like_a_batch(spark, parts):
    e, folder, out = parts
    got = drained(spark, lambda s: counts(s, "ts", "user_id", "1 day", "10 hours", "30 days"), folder, out)
    want = spark.createDataFrame(e).groupBy(F.window("ts", "1 day", "10 hours"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    key = lambda df: sorted((r.start, r.user_id, r.n, round(r.total, 6)) for r in df.collect())
    assert key(got) == key(want.select("window.start", "user_id", "n", "total"))
