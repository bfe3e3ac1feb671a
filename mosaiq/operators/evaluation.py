"""Nearest-neighbour label recognition and label scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import MEASURES, argmax

#: Bytes of a block of examples, and of all blocks that are broadcast at most; beyond it the blocks are dealt to tasks.
BLOCK_BYTES, BROADCAST_BYTES = 4 << 20, 32 << 20


def examples(df: DataFrame, key: str, label: str, number: int = 1, check: bool = False) -> DataFrame:
    """The first ``number`` rows of each label in key order. With ``check``, too few of a label is an error."""
    chosen = df.withColumn("rn", F.row_number().over(Window.partitionBy(label).orderBy(key))).filter(F.col("rn") <= number).drop("rn")
    if check and not chosen.groupBy(label).count().filter(F.col("count") < number).isEmpty():
        raise ValueError("a label has too few examples")
    return chosen


def _blocks(ex: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Examples packed into blocks ``by..., block, book`` by a hash of their id, and the number of blocks of each key at most."""
    size = ex.agg(F.sum(8 * F.size("ev") + 32)).first()[0] or 0
    parts = -(-size // BLOCK_BYTES) or 1
    held = ex.groupBy(*by, F.pmod(F.xxhash64("ex_id"), F.lit(parts)).alias("block")).agg(F.collect_list(F.struct("ex_id", "ex_label", "ev")).alias("book"))
    return F.broadcast(held) if size <= BROADCAST_BYTES else held, parts


def distances(samples: DataFrame, ex: DataFrame, measure: str | Callable[[Column, Column], Column]) -> DataFrame:
    """Every sample ``i, v`` with every example ``ex_id, ev, ex_label`` and their ``dist``.

    Examples come in blocks of a few megabytes, which are broadcast up to a size and else dealt out, and
    a block's distances are taken within the sample's row.
    """
    f = MEASURES[measure] if isinstance(measure, str) else measure
    held, _ = _blocks(ex)
    each = samples.join(held).withColumn("e", F.explode("book"))
    return each.select(*samples.columns, "e.ex_id", "e.ev", "e.ex_label", f(F.col("v"), F.col("e.ev")).alias("dist"))


def nearest(samples: DataFrame, ex: DataFrame, measures: dict[str, Callable[[Column, Column], Column]], by: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """The samples without ``v``, once for each key ``by`` of the examples, with the label of the nearest example under each measure.

    ``on`` are columns in which sample and example must agree. Ties go to the smaller example. One row
    leaves a sample and block; only where there are several blocks do they meet in an aggregation.
    """
    held, parts = _blocks(ex, (*on, *by))
    each = samples.join(held, list(on)) if on else samples.join(held)
    rest = [c for c in samples.columns if c != "v"]

    def least(f: Callable[[Column, Column], Column]) -> Column:
        return F.array_min(F.transform("book", lambda e: F.struct(f(F.col("v"), e["ev"]).alias("dist"), e["ex_id"].alias("ex_id"), e["ex_label"].alias("ex_label"))))

    near = each.select(*rest, *by, *(least(f).alias(name) for name, f in measures.items()))
    if parts > 1:
        near = near.groupBy(*rest, *by).agg(*(F.min(name).alias(name) for name in measures))
    return near.select(*rest, *by, *(F.col(name)["ex_label"].alias(name) for name in measures))


def classify(samples: DataFrame, ex: DataFrame, measure: str | Callable[[Column, Column], Column]) -> DataFrame:
    """``i, label, found``: the label of each sample's nearest example, ties to the smaller example."""
    f = MEASURES[measure] if isinstance(measure, str) else measure
    return nearest(samples.select("i", "label", "v"), ex, {"found": f})


def score(found: DataFrame, label: str = "label", got: str = "found") -> DataFrame:
    return found.agg(F.avg((F.col(label) == F.col(got)).cast("double")).alias("score"))


def recognised(df: DataFrame, scores: str, label: str) -> DataFrame:
    """Adds ``found``, the first place of the largest score, and whether it is the label."""
    return df.withColumn("found", argmax(F.col(scores))).withColumn("correct", F.col("found") == F.col(label))


def top_n_match(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``row, matched``: whether a row's best labels, as many as are true of it, are the true ones.

    ``scores(row, idx, score)``, ``truth(row, idx)``; ties go to the smaller label.
    """
    n = truth.groupBy("row").agg(F.count("*").alias("n"))
    best = scores.withColumn("rn", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "idx"))).join(n, "row").filter("rn <= n")
    hits = best.join(truth, ["row", "idx"], "left_semi").groupBy("row").agg(F.count("*").alias("hits"))
    return n.join(hits, "row", "left").select("row", (F.coalesce("hits", F.lit(0)) == F.col("n")).alias("matched"))


def threshold_match(scores: DataFrame, threshold: float) -> DataFrame:
    """``row, matched``: whether all labels of ``scores(row, score, truth)`` are true just where the score reaches the threshold."""
    return scores.groupBy("row").agg(F.bool_and((F.col("score") >= threshold) == F.col("truth")).alias("matched"))


def stats(scores: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation of ``score`` by key."""
    return scores.groupBy(*by).agg(F.avg("score").alias("avg_score"), F.stddev_pop("score").alias("std_score"))
