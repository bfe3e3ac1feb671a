"""Sliding windows over a stream. Unlike ``operators.windows.slider`` they are aligned to the epoch plus an offset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(stream: DataFrame, time: str, by: str, width: str, shift: str, late: str, start: str = "0 seconds") -> DataFrame:
    """``start, end, by, n, total``: counts and sums of ``value`` in each window, final when the watermark passes it."""
    w = F.window(time, width, shift, start)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", by, "n", "total")
