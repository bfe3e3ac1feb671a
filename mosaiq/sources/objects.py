"""Frames of object recordings: one text line per frame, and feature files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the format: label and time at the end of a frame's file name.
NAME = r"_o([0-9]+)_([0-9]+.[0-9]+)$"
FEATURES = 5


def parse_lines(df: DataFrame, line: str, strict: bool = False) -> DataFrame:
    """Adds ``filename, label, ts, views``: blocks are parted by '|', the first is the name, each other a view of four integers.

    A name without label and time gives nulls, or an error with ``strict``.
    """
    blocks = F.split(F.col(line), r"\|")
    name = F.rtrim(blocks[0])
    ok = name.rlike(NAME)
    label = F.when(ok, F.regexp_extract(name, NAME, 1).cast("int"))
    if strict:
        label = F.when(ok, label).otherwise(F.raise_error(F.concat(F.lit("not a frame name: "), name)))
    views = F.transform(F.slice(blocks, F.lit(2), F.size(blocks) - 1), _view)
    return df.select("*", name.alias("filename"), label.alias("label"), F.when(ok, F.regexp_extract(name, NAME, 2).cast("double")).alias("ts"), views.alias("views"))


def _view(block: Column) -> Column:
    n = F.split(F.trim(block), r"\s+")
    return F.struct(*(n[k].cast("int").alias(f"v{k}") for k in range(4)))


def read_features(spark: SparkSession, paths: str, views: DataFrame) -> DataFrame:
    """``path, view_idx, feature, values`` of feature files: lines last to first, without blank ones.

    A file whose lines aren't five for each of its views, by ``views(path, n_views)``, is left out.
    """
    lines = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.reverse(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("lines"))
    good = lines.join(views, "path").filter(F.size("lines") == F.col("n_views") * FEATURES)
    each = good.select("path", F.posexplode("lines").alias("k", "line"))
    values = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    return each.select("path", F.floor(F.col("k") / FEATURES).cast("int").alias("view_idx"), (F.col("k") % FEATURES).cast("int").alias("feature"), values.alias("values"))


def by_frame(features: DataFrame, key: str = "path") -> DataFrame:
    """``key, feature, j, x``: the mean of a frame's views; a shorter view has zeros at its end."""
    n = features.groupBy(key).agg(F.countDistinct("view_idx").alias("n"))
    cells = features.select(key, "feature", F.posexplode("values").alias("j", "x")).groupBy(key, "feature", "j").agg(F.sum("x").alias("s"))
    return cells.join(n, key).select(key, "feature", "j", (F.col("s") / F.col("n")).alias("x"))


def with_names(frames: DataFrame, names: dict[int, str], keep: set[str]) -> DataFrame:
    """Frames whose object's name is wanted, with ``name``."""
    m = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return frames.withColumn("name", F.element_at(m, F.col("label"))).filter(F.col("name").isin(*keep))
