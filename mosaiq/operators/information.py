"""Entropy, information and counts over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import minmax
from .pairing import small


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)


def distribution(df: DataFrame, *by: str) -> DataFrame:
    """``by..., p``: the share of rows of each group."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(n)).select(*by, (F.col("n") / F.col("total")).alias("p"))


def entropy(p: DataFrame) -> DataFrame:
    return p.agg((-F.sum(_plogp(F.col("p")))).alias("entropy"))


def _marginals(p: DataFrame, a: str, b: str) -> DataFrame:
    x, y = p.groupBy(a).agg(F.sum("p").alias("pa")), p.groupBy(b).agg(F.sum("p").alias("pb"))
    return p.join(x, a).join(y, b)


def mutual_information(p: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of a joint distribution ``a, b, p``, in nats; groups ``by`` are distributions of their own."""
    x, y = p.groupBy(*by, a).agg(F.sum("p").alias("pa")), p.groupBy(*by, b).agg(F.sum("p").alias("pb"))
    cells = p.join(x, [*by, a]).join(y, [*by, b])
    term = F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).otherwise(0.0)
    return cells.groupBy(*by).agg(F.sum(term).alias("mi"))


def conditional_entropy(p: DataFrame, given: str) -> DataFrame:
    """H(all) - H(given)."""
    whole = p.agg(F.sum(_plogp(F.col("p"))).alias("h"))
    part = p.groupBy(given).agg(F.sum("p").alias("p")).agg(F.sum(_plogp(F.col("p"))).alias("g"))
    return whole.join(F.broadcast(part)).select((F.col("g") - F.col("h")).alias("conditional_entropy"))


def two_by_two_information(n11: Column, n10: Column, n01: Column, n: Column) -> Column:
    """Information in nats between two events from the counts of both, of each alone, and of all."""
    n00 = n - n11 - n10 - n01
    out = F.lit(0.0)
    for both, row, column in ((n11, n11 + n10, n11 + n01), (n10, n11 + n10, n10 + n00), (n01, n01 + n00, n11 + n01), (n00, n01 + n00, n10 + n00)):
        out = out + F.when(both > 0, both / n * F.ln(both * n / (row * column))).otherwise(0.0)
    return out


def word_label_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """``word, label, n``: records of a label in which a word, lower-cased and without final marks, is present."""
    words = F.array_distinct(F.transform(F.split(F.lower(text), " "), lambda w: F.regexp_replace(w, "^[.?!]+|[.?!]+$", "")))
    return df.select(F.col(label).alias("label"), F.explode(words).alias("word")).filter("word <> ''").groupBy("word", "label").agg(F.count("*").alias("n"))


def word_label_information(df: DataFrame, text: str, label: str) -> DataFrame:
    """``word, label, mi`` for each word and label: how much a word's presence tells of the label."""
    counts = word_label_counts(df, text, label)
    words = counts.groupBy("word").agg(F.sum("n").alias("nw"))
    labels = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("nl"))
    n = df.agg(F.count("*").alias("total"))
    every = counts.join(words, "word").join(small(labels), "label").join(F.broadcast(n))
    d = lambda c: F.col(c).cast("double")
    return every.select("word", "label", two_by_two_information(d("n"), d("nw") - d("n"), d("nl") - d("n"), d("total")).alias("mi"))


def equal_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Which of equal bins between the bounds holds x: the last one holds the maximum, and the first all of a constant column."""
    return F.least(F.floor(minmax(x, low, high) * bins), F.lit(bins - 1))


def histogram_by_label(df: DataFrame, value: str, label: str, bins: int = 10) -> DataFrame:
    """``label, bin, n`` over equal bins of the whole range; the last bin holds the maximum."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = equal_bin(F.col(value), F.col("lo"), F.col("hi"), bins)
    return df.join(F.broadcast(bounds)).groupBy(F.col(label).alias("label"), at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def label_information(hist: DataFrame, by: str) -> DataFrame:
    """``by, label, mi``: information between being of a label and the bin, from ``by, label, bin, n``."""
    bins = hist.groupBy(by, "bin").agg(F.sum("n").alias("nb"))
    total = hist.groupBy(by).agg(F.sum("n").alias("total"))
    labels = hist.groupBy(by, "label").agg(F.sum("n").alias("nl"))
    cells = labels.join(bins, by).join(total, by).join(hist.select(by, "label", "bin", "n"), [by, "label", "bin"], "left")
    n, nb, nl, t = F.coalesce("n", F.lit(0)).cast("double"), F.col("nb").cast("double"), F.col("nl").cast("double"), F.col("total").cast("double")
    part = F.when(n > 0, n / t * F.ln(n * t / (nb * nl))).otherwise(0.0) + F.when(nb > n, (nb - n) / t * F.ln((nb - n) * t / (nb * (t - nl)))).otherwise(0.0)
    return cells.groupBy(by, "label").agg(F.sum(part).alias("mi"))


def confusion(df: DataFrame, truth: str, found: str) -> DataFrame:
    """``truth, found, n`` with a zero for each pair of labels that doesn't occur."""
    labels = df.select(F.col(truth).alias("label")).union(df.select(F.col(found).alias("label"))).distinct()
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count("*").alias("n"))
    grid = labels.select(F.col("label").alias("truth")).crossJoin(small(labels.select(F.col("label").alias("found"))))
    return grid.join(counts, ["truth", "found"], "left").select("truth", "found", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tag_cooccurrence(df: DataFrame, key: str, tag: str) -> DataFrame:
    """``a, b, n``: records that have both of two different tags, in either order."""
    each = df.select(key, tag).distinct()
    return each.select(key, F.col(tag).alias("a")).join(each.select(key, F.col(tag).alias("b")), key).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
