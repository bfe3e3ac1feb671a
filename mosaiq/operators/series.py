"""Ordered series: differences, lagged co-occurrences, averages and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def velocities(x: str, by: str, *order: str) -> Column:
    """Next minus current; the last wraps around to the first."""
    w = Window.partitionBy(by).orderBy(*order)
    return F.coalesce(F.lead(x).over(w), F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) - F.col(x)


def delayed_velocities(x: str, delay: int, by: str, *order: str) -> Column:
    """Current minus the value ``delay`` rows before, which is 0 where there is none."""
    return F.col(x) - F.coalesce(F.lag(x, delay).over(Window.partitionBy(by).orderBy(*order)), F.lit(0.0))


def delayed_velocities_circular(df: DataFrame, x: str, delay: int, by: str, *order: str, name: str = "velocity") -> DataFrame:
    """Adds ``name``: current minus the value ``delay`` rows before, taken from the series' end where there is none.

    A delay above a series' length counts as that length. Only the first rows of each series are joined,
    with as many last ones.
    """
    w = Window.partitionBy(by).orderBy(*order)
    every = df.withColumns({"__at": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(by)), "__before": F.lag(x, delay).over(w)})
    short = F.least(F.lit(delay).cast("long"), F.col("__n"))
    last = every.filter(F.col("__at") > F.col("__n") - short).select(by, (F.col("__at") - F.col("__n") + short).alias("__at"), F.col(x).alias("__last"))
    return every.join(last, [by, "__at"], "left").withColumn(name, F.col(x) - F.when(F.col("__at") > short, F.col("__before")).otherwise(F.col("__last"))).select(*df.columns, name)


def moving_average3(x: str, by: str, *order: str) -> Column:
    """Mean of a value and its neighbours; the ends stand for their missing neighbours."""
    w = Window.partitionBy(by).orderBy(*order)
    return (F.coalesce(F.lag(x).over(w), F.col(x)) + F.col(x) + F.coalesce(F.lead(x).over(w), F.col(x))) / 3


def cooccurrences(df: DataFrame, code: str, codes: int, lags: list[int], by: str, *order: str) -> DataFrame:
    """``by, code, n``: counts of (code after a lag) * codes + code, each lag in a block of codes**2 of its own."""
    if any(lag < 1 for lag in lags):
        raise ValueError("lags start at 1")
    w = Window.partitionBy(by).orderBy(*order)
    pairs = F.array(*(F.lead(code, lag).over(w) * codes + F.col(code) + k * codes**2 for k, lag in enumerate(lags)))
    return df.select(by, pairs.alias("p")).select(by, F.explode("p").alias("code")).filter("code IS NOT NULL").groupBy(by, F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"))


def with_folds(df: DataFrame, ratio: float, *order) -> DataFrame:
    """Adds ``fold``: equal test folds of int(ratio * n) rows in the given order, int(1 / ratio) at most; the rest has none.

    Rows are numbered within ranges that a global sort makes, so that no task holds the table.
    """
    n = df.count()
    size = int(ratio * n)
    if size < 1:
        raise ValueError("a fold has no rows")
    fold = F.floor((F.col("rn") - 1) / size)
    return ranked(df, *order).withColumn("fold", F.when(fold < int(1 / ratio + 1e-9), fold).cast("long"))


def ranked(df: DataFrame, *order, name: str = "rn") -> DataFrame:
    """Adds the row's number in a total order: sorted ranges are counted, and offsets added, without one big partition.

    The sorted rows are checkpointed, since a second sort of fewer columns may have other ranges.
    """
    part = df.orderBy(*order).withColumn("__p", F.spark_partition_id())
    part = part.withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)).checkpoint()
    sizes = part.groupBy("__p").agg(F.count("*").alias("__m"))
    before = sizes.select("__p", (F.sum("__m").over(Window.orderBy("__p")) - F.col("__m")).alias("__before"))
    return part.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + F.col("__k") + 1).cast("long")).drop("__p", "__k", "__before")


def leave_one_out(folds: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``fold, key`` of the rows that train in each fold: all but the fold's own."""
    return folds.select(F.col(key).alias("fold")).join(rows.select(key), F.col("fold") != F.col(key))
