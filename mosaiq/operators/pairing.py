"""Pairing samples of several modalities by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from .series import ranked


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Adds ``label_idx``, the place of the row's label among the sorted labels. Only the distinct labels are ranked."""
    labels = df.select(label).distinct()
    labels = labels.withColumn("label_idx", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))
    return df.join(labels, label)


def numbered(df: DataFrame, by: str, *order) -> DataFrame:
    """Adds ``rn``, the row's number within its key: numbers of a sort by key and order, less the key's first, so that a key with most rows is many tasks' work."""
    every = ranked(df, by, *order, name="__n")
    first = every.groupBy(by).agg(F.min("__n").alias("__first"))
    return every.join(first, by).withColumn("rn", F.col("__n") - F.col("__first") + 1).drop("__n", "__first")


def seeded_order(key: str, seed: int):
    """An order that shuffles rows the same way on every run."""
    return F.xxhash64(F.col(key), F.lit(seed))


def pair(modalities: dict[str, tuple[DataFrame, str, str]], seed: int | None = None, check: bool = True) -> DataFrame:
    """``label_idx, rn`` and a key column per modality: samples whose labels have the same index, zipped within the label.

    Each modality is (rows, key, label). The shortest bucket of a label decides its pairs. Samples come
    in key order, or shuffled by ``seed``. Modalities must have equally many labels.
    """
    if check and len({rows.select(label).distinct().count() for rows, _, label in modalities.values()}) > 1:
        raise ValueError("modalities have different numbers of labels")
    out = None
    for name, (rows, key, label) in modalities.items():
        order = (F.col(key),) if seed is None else (seeded_order(key, seed), F.col(key))
        part = numbered(label_index(rows.select(key, label), label), "label_idx", *order).select("label_idx", "rn", F.col(key).alias(name))
        out = part if out is None else out.join(part, ["label_idx", "rn"])
    return out


def buckets(df: DataFrame, key: str, label: str, labels: DataFrame) -> DataFrame:
    """``label, members``: the sorted keys of each of ``labels(label)``, empty where there is none."""
    members = df.groupBy(F.col(label).alias("label")).agg(F.array_sort(F.collect_list(key)).alias("members"))
    return labels.join(members, "label", "left").select("label", F.coalesce("members", F.array().cast(members.schema["members"].dataType)).alias("members"))


def zip_shortest(*arrays):
    """Arrays zipped up to the shortest."""
    n = F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), F.lit(1), n)


def gathered(rows: DataFrame, key: str, index: DataFrame, at: str) -> DataFrame:
    """The rows whose ``key`` the column ``at`` of ``index`` names, with the index's other columns: once for each time that it does, in whatever order it gives."""
    return index.withColumnRenamed(at, key).join(rows, key)


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _width(c: Column, kind: DataType) -> Column:
    """About the bytes of a column's value."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        flat = not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType, MapType))
        inner = F.size(c) * 8 if flat else F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + _width(x, kind.elementType).cast("long"))
        return F.coalesce(inner, F.lit(0)) + 16
    if isinstance(kind, MapType):
        return _width(F.map_keys(c), ArrayType(kind.keyType)) + _width(F.map_values(c), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """About the bytes of all rows, as counted."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(row)).first()[0] or 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, broadcast where its rows have at most ``most`` bytes, as counted; beyond it joins shuffle, and no row goes."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def distribute(df: DataFrame, values: DataFrame) -> DataFrame:
    """Every row with every value; the values are broadcast where they are a short list of settings."""
    return df.crossJoin(small(values))
