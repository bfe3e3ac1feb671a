"""Recognition along a timeline: co-occurrence features of sliding windows, their coefficients, and the nearest examples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import MEASURES
from . import evaluation, factorize


def pane_cooccurrences(points: DataFrame, t: str, origin: str, width: int, shift: int, code: str, codes: int, lags: list[int], by: str, *order: str) -> DataFrame:
    """``by, window, cell, n``: in each sliding window (start, end] from ``origin`` on, how often a code follows another after a lag.

    A cell is (code after the lag) * codes + code, each lag in a block of codes**2 of its own. A pair counts
    in the windows that hold both of its points. Width and shift are whole numbers; time is cut into panes of
    their greatest common divisor. Each pair of points is made once and counted under its first
    point's pane and the number of panes to its second's, so that pairs across panes are kept, and a
    window adds up the counts whose panes it holds: no point is read again for another window. Pairs that
    no window is wide enough for go before the counts. Windows from 0 up to any number are given: the caller joins those that exist.
    Points at or before the origin, and without a code, take no part, but those without a code stay in the order.
    """
    if any(lag < 1 for lag in lags):
        raise ValueError("lags start at 1")
    pane = math.gcd(width, shift)
    step, panes = shift // pane, width // pane
    w = Window.partitionBy(by).orderBy(*order)
    at = lambda x: F.ceil((x - F.col(origin)) / pane) - 1
    pairs = F.array(*(F.struct((F.lead(code, lag).over(w) * codes + F.col(code) + k * codes**2).cast("long").alias("cell"), at(F.lead(t, lag).over(w)).alias("last")) for k, lag in enumerate(lags)))
    each = points.filter(F.col(t) > F.col(origin)).select(by, at(F.col(t)).alias("first"), pairs.alias("p")).select(by, "first", F.explode("p").alias("p")).select(by, "first", (F.col("p.last") - F.col("first")).alias("span"), "p.cell")
    counts = each.filter((F.col("span") < panes) & F.col("cell").isNotNull()).groupBy(by, "first", "span", "cell").agg(F.count("*").alias("n"))
    low, high = F.greatest(F.ceil((F.col("first") + F.col("span") - panes + 1) / step), F.lit(0)), F.floor(F.col("first") / step)
    return counts.filter(low <= high).select(by, F.explode(F.sequence(low, high)).alias("window"), "cell", "n").groupBy(by, "window", "cell").agg(F.sum("n").alias("n"))


def window_vectors(counts: DataFrame, by: str, coef: float = 1.0) -> DataFrame:
    """``i, by, window, idx, x``: a sparse row for each window of ``pane_cooccurrences``, times a modality's coefficient; ``i`` numbers the windows."""
    cells = counts.groupBy(by, "window").agg(F.array_sort(F.collect_list(F.struct(F.col("cell").cast("int").alias("j"), (F.col("n") * coef).cast("double").alias("x")))).alias("cells"))
    return cells.select(F.monotonically_increasing_id().alias("i"), by, "window", F.col("cells.j").alias("idx"), F.col("cells.x").alias("x")).checkpoint()


def recognised(counts: DataFrame, by: str, dictionary: np.ndarray, examples: DataFrame, measure: str = "cosine", steps: int = 50, coef: float = 1.0) -> DataFrame:
    """``by, window, label``: each window's nearest example by the coefficients of its counts.

    ``dictionary`` (k x cells) is the learned dictionary's part for the windows' modality; ``examples`` holds
    ``ex_id, ex_label, ev``, the examples' coefficients under the other modality's part. A window without a pair
    has no counts and gives no row. Ties go to the smaller example.
    """
    rows = window_vectors(counts, by, coef)
    found = factorize.transform(rows.select("i", "idx", "x"), dictionary, steps).withColumnRenamed("w", "v")
    near = evaluation.nearest(found, examples, {"label": MEASURES[measure]})
    return near.join(rows.select("i", by, "window"), "i").select(by, "window", "label")
