"""Matrices as long tables ``i, j, x`` of their nonzero cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(rows: DataFrame, key: str, vector: str, value=None) -> DataFrame:
    """``i, j, x`` of an array column; ``value`` maps a component, such as F.abs."""
    v = F.col(vector).cast("array<double>")
    return rows.select(F.col(key).alias("i"), F.posexplode(F.transform(v, value) if value else v).alias("j", "x")).select("i", F.col("j").cast("long"), "x")


def normalize_sum(m: DataFrame, by: str, eps: float = 1e-16) -> DataFrame:
    """Cells divided by the sum of their row (``by`` i) or column (j). The sums are aggregated before the join."""
    sums = m.groupBy(by).agg(F.sum("x").alias("s"))
    return m.join(sums, by).select("i", "j", (F.col("x") / (F.col("s") + eps)).alias("x"))


def normalize_features(m: DataFrame) -> DataFrame:
    """Columns divided by their sums, without zero columns; those left are numbered anew."""
    sums = m.groupBy("j").agg(F.sum("x").alias("s")).filter("s <> 0")
    sums = sums.withColumn("new", F.row_number().over(Window.orderBy("j")) - 1)
    return m.join(sums, "j").select("i", F.col("new").cast("long").alias("j"), (F.col("x") / F.col("s")).alias("x"))


def scale(m: DataFrame, factors: DataFrame, by: str) -> DataFrame:
    """Rows or columns times ``factors(by, f)``."""
    return m.join(factors, by).select("i", "j", (F.col("x") * F.col("f")).alias("x"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a(i, k, x)`` times ``b(k, j, x)``."""
    return a.select("i", "k", F.col("x").alias("ax")).join(b.select("k", "j", F.col("x").alias("bx")), "k").groupBy("i", "j").agg(F.sum(F.col("ax") * F.col("bx")).alias("x"))


def masked_dot(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """The product's cells where ``mask(i, j, x)`` isn't 0; only those are computed."""
    cells = mask.filter("x <> 0").select("i", "j")
    return cells.join(a.select("i", "k", F.col("x").alias("ax")), "i").join(b.select("k", "j", F.col("x").alias("bx")), ["k", "j"]).groupBy("i", "j").agg(F.sum(F.col("ax") * F.col("bx")).alias("x"))


def hstack(*parts: tuple[DataFrame, int]) -> DataFrame:
    """Matrices side by side, given with their widths."""
    out, offset = None, 0
    for m, width in parts:
        part = m.select("i", (F.col("j") + offset).cast("long").alias("j"), "x")
        out, offset = part if out is None else out.unionByName(part), offset + width
    return out


def vstack(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def width(m: DataFrame) -> DataFrame:
    return m.agg(F.max("j").alias("w")).select((F.col("w") + 1).cast("long").alias("width"), )


def violations(m: DataFrame) -> DataFrame:
    """How many cells are negative, and how many aren't finite."""
    odd = F.isnan("x") | (F.abs("x") == float("inf")) | F.col("x").isNull()
    return m.agg(F.count_if(F.col("x") < 0).alias("negative"), F.count_if(odd).alias("not_finite"), F.count("*").alias("cells"))


def checked_nonnegative(x: Column) -> Column:
    """x, or an error where it is negative or not finite."""
    return F.when((x < 0) | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("negative or not finite"))).otherwise(x)


def sparsity(m: DataFrame, rows: int | Column, columns: int | Column) -> DataFrame:
    """The share of zero cells."""
    return m.agg((1 - F.count_if(F.col("x") != 0) / (F.lit(rows) * F.lit(columns))).alias("sparsity"))
