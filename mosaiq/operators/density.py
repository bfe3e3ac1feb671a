"""Gaussian kernel density by linear binning, in one and two dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value added inside logarithms.
EPSILON = 1e-14


def _split(x: Column, low: float, step: float) -> Column:
    at = F.floor((x - low) / step)
    part = (x - low) / step - at
    return F.array(F.struct(at.alias("bin"), (1 - part).alias("w")), F.struct((at + 1).alias("bin"), part.alias("w")))


def bins1d(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, density``: each value's weight goes to its two neighbours on the grid of ``bins`` + 1 points, over n * step."""
    step = (high - low) / bins
    n = df.agg(F.count("*").alias("n"))
    cells = df.select(F.inline(_split(F.col(x), low, step))).filter((F.col("bin") >= 0) & (F.col("bin") <= bins)).groupBy("bin").agg(F.sum("w").alias("w"))
    return cells.filter("w <> 0").join(F.broadcast(n)).select(F.col("bin").cast("long").alias("bin"), (F.col("w") / (F.col("n") * step)).alias("density"))


def bins2d(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., bin_x, bin_y, density``: weights go to four neighbours."""
    x0, x1, y0, y1 = bounds
    sx, sy = (x1 - x0) / bins, (y1 - y0) / bins
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    cells = df.select(*by, F.explode(_split(F.col(x), x0, sx)).alias("a"), F.col(y).alias("__y")).select(*by, "a", F.explode(_split(F.col("__y"), y0, sy)).alias("b"))
    cells = cells.groupBy(*by, F.col("a.bin").alias("bin_x"), F.col("b.bin").alias("bin_y")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("w")).filter(f"w <> 0 AND bin_x BETWEEN 0 AND {bins} AND bin_y BETWEEN 0 AND {bins}")
    counted = cells.join(n, list(by)) if by else cells.join(F.broadcast(n))
    return counted.select(*by, F.col("bin_x").cast("long").alias("bin_x"), F.col("bin_y").cast("long").alias("bin_y"), (F.col("w") / (F.col("n") * sx * sy)).alias("density"))


def kernel(step: float, h: float, reach: float = 4.0) -> list[float]:
    """Gaussian weights at whole steps within ``reach`` deviations; they sum to 1."""
    k = max(1, int(reach * h / step))
    w = [math.exp(-0.5 * (d * step / h) ** 2) for d in range(-k, k + 1)]
    s = sum(w)
    return [x / s for x in w]


def smooth(cells: DataFrame, by: list[str], weights: list[float] | dict[str, list[float]], bins: int, full: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    """The cells' density spread along each of the bin columns ``by``, on the grid from 0 to ``bins``; within ``groups``.

    With ``full`` what goes beyond the grid is kept, in bins below 0 and above ``bins``. The weights are
    the same for all bin columns or given by column.
    """
    out = cells
    for b in by:
        each = weights[b] if isinstance(weights, dict) else weights
        k = len(each) // 2
        spread = F.array(*(F.struct(F.lit(d - k).alias("d"), F.lit(w).alias("k")) for d, w in enumerate(each)))
        moved = out.select(*groups, *by, "density", F.inline(spread)).withColumn(b, F.col(b) + F.col("d"))
        moved = moved if full else moved.filter((F.col(b) >= 0) & (F.col(b) <= bins))
        out = moved.groupBy(*groups, *by).agg(F.sum(F.col("density") * F.col("k")).alias("density"))
    return out


def entropy1d(density: DataFrame, step: float, bins: int) -> DataFrame:
    """- integral of f ln f by trapezoids over the whole grid."""
    y = -F.col("density") * F.ln(F.col("density") + EPSILON)
    ends = F.when(F.col("bin").isin(0, bins), 0.5).otherwise(1.0)
    return density.agg((F.sum(y * ends) * step).alias("entropy"))


def kl1d(a: DataFrame, b: DataFrame, step: float, bins: int, positive: bool = False) -> DataFrame:
    """The integral of f ln(f / g), negated unless ``positive``; both densities are on one grid."""
    both = a.select("bin", F.col("density").alias("f")).join(b.select("bin", F.col("density").alias("g")), "bin", "full")
    f, g = F.coalesce("f", F.lit(0.0)), F.coalesce("g", F.lit(0.0))
    y = f * F.ln((f + EPSILON) / (g + EPSILON)) * F.when(F.col("bin").isin(0, bins), 0.5).otherwise(1.0)
    return both.agg((F.sum(y) * (step if positive else -step)).alias("kl"))


def _ends2d(bins: int) -> Column:
    half = lambda b: F.when(F.col(b).isin(0, bins), 0.5).otherwise(1.0)
    return half("bin_x") * half("bin_y")


def entropy2d(density: DataFrame, step_x: float, step_y: float, bins: int) -> DataFrame:
    """- integral of f ln f over the plane's grid by trapezoids in both directions."""
    return density.agg((F.sum(-F.col("density") * F.ln(F.col("density") + EPSILON) * _ends2d(bins)) * step_x * step_y).alias("entropy"))


def kl2d(f: DataFrame, g: DataFrame, step_x: float, step_y: float, bins: int) -> DataFrame:
    """- integral of f ln(f / g), as ``kl1d``."""
    both = f.withColumnRenamed("density", "f").join(g.withColumnRenamed("density", "g"), ["bin_x", "bin_y"], "full").na.fill(0.0, ["f", "g"])
    return both.agg((F.sum(F.col("f") * F.ln((F.col("f") + EPSILON) / (F.col("g") + EPSILON)) * _ends2d(bins)) * -step_x * step_y).alias("kl"))
