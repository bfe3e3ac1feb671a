"""Time windows: sliding, tumbling, cropping, alignment, and lookup of points in intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import tolerant_ceil, tolerant_floor
from .pairing import numbered

#: Fixed values of the window algebra: tolerance in seconds, and on counts of windows.
TOL, TOL_COUNT = 1e-8, 1e-3


def slider(df: DataFrame, t0: Column, t1: Column, width: Column, shift: Column, partial: bool = False) -> DataFrame:
    """One row per window ``start, end`` of ``width`` every ``shift`` from t0: full ones, or also those that t1 cuts off.

    Windows are anchored at each row's t0, not at the epoch. Counts tolerate rounding, and an end near t1 is t1.
    """
    last = tolerant_ceil((t1 - t0) / shift, TOL_COUNT) - 1 if partial else tolerant_floor((t1 - t0 - width) / shift, TOL_COUNT)
    k = F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>")))
    w = df.select("*", t0.alias("__t0"), t1.alias("__t1"), width.alias("__w"), shift.alias("__s"), k.alias("window"))
    end = F.col("__t0") + F.col("window") * F.col("__s") + F.col("__w")
    snapped = F.when(end > F.col("__t1") - TOL, F.col("__t1")).otherwise(end)
    return w.withColumn("start", F.col("__t0") + F.col("window") * F.col("__s")).withColumn("end", snapped).drop("__t0", "__t1", "__w", "__s")


def measured(df: DataFrame) -> DataFrame:
    """Adds ``duration`` and ``mean_time`` of windows ``start, end``."""
    return df.withColumn("duration", F.col("end") - F.col("start")).withColumn("mean_time", (F.col("start") + F.col("end")) / 2)


def moved(df: DataFrame, by: Column) -> DataFrame:
    """Windows ``start, end`` moved in time; what was measured of them before stays."""
    return df.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by)


def sample_times(n: Column, start: Column, rate: Column) -> Column:
    """The middles of ``n`` samples' cells of 1 / rate, the first of which begins at ``start``."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: start + (k + 0.5) / rate)).otherwise(F.array().cast("array<double>"))


def frames(df: DataFrame, t0: Column, t1: Column, rate: float) -> DataFrame:
    """Windows of 1 / rate one after another; the last may be short."""
    return slider(df, t0, t1, F.lit(1 / rate), F.lit(1 / rate), partial=True)


def crop(start: Column, end: Column, ts: Column, te: Column) -> Column:
    """The part of a window within [ts, te]; empty at ts if te is before ts."""
    s = F.greatest(start, ts)
    return F.struct(s.alias("start"), F.greatest(s, F.least(end, te)).alias("end"))


def align(df: DataFrame, duration: str, by: str, *order: str) -> DataFrame:
    """Adds ``start, end``: windows of the given durations one behind another from 0."""
    w = Window.partitionBy(by).orderBy(*order)
    start = F.coalesce(F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("start", start).withColumn("end", start + F.col(duration))


def gaps(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``by, n_gaps``: how often a window doesn't start where the one before it ends."""
    w = Window.partitionBy(by).orderBy(*order)
    gap = F.abs(F.lead("start").over(w) - F.col("end")) > TOL
    return df.withColumn("__gap", gap).groupBy(by).agg(F.count_if(F.col("__gap")).alias("n_gaps"))


def dyadic_cells(low: Column, high: Column) -> Column:
    """The dyadic cells ``level, cell`` that make up the whole numbers from ``low`` to ``high``: two at most of each level.

    Cell c of level l holds the numbers from c * 2**l up to the next cell; an interval of n numbers has at
    most 2 log2 n cells, and none overlap.
    """
    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a, b = F.floor((low + size - 1) / size), F.floor((high + 1) / size)
        left = F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.array(a)).otherwise(F.array().cast("array<bigint>"))
        right = F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), F.array(b - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.concat(left, right), lambda c: F.struct(level.alias("level"), c.alias("cell")))

    # An interval of n numbers has no cell above level log2 n.
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2((high - low + 1).cast("double"))).cast("int")), of_level))


def lookup(points: DataFrame, t: str, intervals: DataFrame, by: str, bucket: float) -> DataFrame:
    """Points with the interval (start, end] of their group that holds them; a group's first interval holds its start too.

    Time is cut into buckets, and an interval's buckets are written as dyadic cells: a number of rows that
    grows with the logarithm of its length. A point looks up its cell of each level that the longest interval may have, so that the
    range condition becomes an equality join with a check. Intervals that end before they start hold nothing.
    The joins shuffle: the planner takes the size of the file for that of the cells, and would broadcast them.
    """
    low, high = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
    first = intervals.groupBy(by).agg(F.min("start").alias("__first"))
    spread = intervals.filter("start <= end").join(first.hint("merge"), by).withColumn("__c", F.explode(dyadic_cells(low, high)))
    spread = spread.withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    longest = intervals.filter("start <= end").agg(F.max(high - low + 1)).first()[0] or 1
    levels = range(int(longest).bit_length())
    at = F.floor(F.col(t) / bucket)
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.shiftright(at, x).alias("cell")) for x in levels)))
    placed = points.withColumn("__c", cells).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    hit = (F.col(t) > F.col("start")) & (F.col(t) <= F.col("end")) | (F.col("start") == F.col("__first")) & (F.col(t) == F.col("start"))
    return placed.join(spread.hint("merge"), [by, "__level", "__cell"]).filter(hit).drop("__level", "__cell", "__first")


def consecutive(pieces: DataFrame, by: str) -> DataFrame:
    """Adds ``n``, a piece's number in its timeline by start; a gap or an overlap of neighbours is an error when the rows are read."""
    each = numbered(pieces, by, "start", "end").withColumnRenamed("rn", "n")
    before = each.select(by, (F.col("n") + 1).alias("n"), F.col("end").alias("__before"))
    wrong = F.abs(F.col("__before") - F.col("start")) > TOL
    joined = each.join(before, [by, "n"], "left")
    return joined.withColumn("start", F.when(wrong, F.raise_error(F.lit("pieces are not consecutive")).cast("double")).otherwise(F.col("start"))).select(*each.columns)


def cut(pieces: DataFrame, cuts: DataFrame, by: str, bucket: float, samples: bool = True) -> DataFrame:
    """``cuts(by, cut, ts, te)`` of timelines that are made of pieces: the parts, or the samples, between two times.

    ``pieces`` has ``by, start, end``, consecutive within a timeline, and with ``samples`` also ``rate`` and
    ``samples``. Both ends of a cut are looked up: a time belongs to the first piece that ends at it or
    later. A cut has all pieces from the one to the other; the first begins at ts, the last ends at te. A time that is
    no piece's is an error, as is a cut that ends before it starts.

    Without ``samples`` the rows are the parts: the pieces' columns with ``cut, start, end`` cropped. With
    it there is a row ``by, cut, start, rate, samples`` for each cut: of the first piece the samples
    whose cells begin at ts or later, of the last those whose cells end by te, one behind another in one array; pieces of
    different rates are an error. Only the pieces that a cut has are joined to it, by number.
    """
    held = consecutive(pieces, by)
    index = held.select(by, F.col("n").alias("__n"), "start", "end")
    ends = cuts.select(by, "cut", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ts").alias("t")), F.struct(F.lit(1).alias("side"), F.col("te").alias("t")))).alias("e")).select(by, "cut", "e.side", "e.t")
    found = lookup(ends, "t", index, by, bucket).groupBy(by, "cut").agg(F.min(F.when(F.col("side") == 0, F.col("__n"))).alias("__a"), F.min(F.when(F.col("side") == 1, F.col("__n"))).alias("__b"))
    wrong = F.col("__a").isNull() | F.col("__b").isNull() | (F.col("te") < F.col("ts"))
    ranges = cuts.join(found, [by, "cut"], "left")
    ranges = ranges.withColumn("__a", F.when(wrong, F.raise_error(F.lit("a cut is out of its timeline")).cast("long")).otherwise(F.col("__a")))
    parts = ranges.withColumn("n", F.explode(F.sequence("__a", "__b"))).join(held, [by, "n"])
    first, last = F.col("n") == F.col("__a"), F.col("n") == F.col("__b")
    if not samples:
        cropped = parts.withColumn("start", F.when(first, F.col("ts")).otherwise(F.col("start"))).withColumn("end", F.when(last, F.col("te")).otherwise(F.col("end")))
        return cropped.drop("__a", "__b", "ts", "te", "n")
    r = sample_range(F.col("start"), F.col("rate"), F.col("ts"), F.col("te"))
    low = F.when(first, F.greatest(r["low"], F.lit(0))).otherwise(F.lit(0))
    high = F.when(last, F.least(r["high"], F.size("samples"))).otherwise(F.size("samples"))
    own = parts.withColumns({"__low": low, "__high": high})
    own = own.select(by, "cut", "n", "rate", (F.col("start") + F.col("__low") / F.col("rate")).alias("start"), F.slice("samples", (F.col("__low") + 1).cast("int"), F.greatest(F.col("__high") - F.col("__low"), F.lit(0)).cast("int")).alias("samples"))
    whole = own.groupBy(by, "cut").agg(F.array_sort(F.collect_list(F.struct("n", "start", "samples"))).alias("p"), F.min("rate").alias("rate"), F.max("rate").alias("__most"))
    rate = F.when(F.col("rate") == F.col("__most"), F.col("rate")).otherwise(F.raise_error(F.lit("pieces of different rates")).cast(own.schema["rate"].dataType))
    return whole.select(by, "cut", F.col("p")[0]["start"].alias("start"), rate.alias("rate"), F.flatten(F.col("p.samples")).alias("samples"))


def associate_frames(labelled: DataFrame, pool: DataFrame, label: str, frame: str, order: str, pool_order: str, check: bool = False) -> DataFrame:
    """Gives each labelled window the next unused frame of its label; with ``check`` it is an error if one is left without, else its frame is null."""
    a, b = numbered(labelled, label, order), numbered(pool.select(label, frame, *({pool_order} - {label, frame})), label, pool_order).select(label, frame, "rn")
    got = a.join(b, [label, "rn"], "left").drop("rn")
    if check and not got.filter(F.col(frame).isNull()).isEmpty():
        raise ValueError("the frames of a label have run out")
    return got


def pane_counts(points: DataFrame, t: str, origin: str, width: int, shift: int, *by: str) -> DataFrame:
    """``by..., window, n``: points in each sliding window (start, end] from ``origin`` on, counted by panes that windows share.

    Width and shift are whole numbers; a pane is as long as their greatest common divisor. Windows from
    0 up to any number are given: the caller joins those that exist.
    """
    pane = math.gcd(width, shift)
    step, panes = shift // pane, width // pane
    at = F.ceil((F.col(t) - F.col(origin)) / pane) - 1
    counts = points.filter(F.col(t) > F.col(origin)).groupBy(*by, at.alias("pane")).agg(F.count("*").alias("n"))
    low, high = F.greatest(F.ceil((F.col("pane") - panes + 1) / step), F.lit(0)), F.floor(F.col("pane") / step)
    return counts.filter(low <= high).select(*by, F.explode(F.sequence(low, high)).alias("window"), "n").groupBy(*by, "window").agg(F.sum("n").alias("n"))


def sample_range(start: Column, rate: Column, ts: Column, te: Column) -> Column:
    """First sample of [ts, te] in a window, and the one behind the last; samples are whole cells of 1 / rate."""
    return F.struct(tolerant_ceil((ts - start) * rate, TOL_COUNT).alias("low"), tolerant_floor((te - start) * rate, TOL_COUNT).alias("high"))


def subwindow(samples: Column, start: Column, rate: Column, ts: Column, te: Column) -> Column:
    """The samples whose cells are within [ts, te], and where the first one's cell starts."""
    r = sample_range(start, rate, ts, te)
    low = F.greatest(r["low"], F.lit(0))
    n = F.greatest(F.least(r["high"], F.size(samples)) - low, F.lit(0))
    return F.struct((start + low / rate).alias("start"), F.slice(samples, (low + 1).cast("int"), n.cast("int")).alias("samples"))
