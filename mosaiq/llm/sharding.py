"""Sharding by extendible hashing: a directory indexed by hash-prefix bits whose oversized buckets alone split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

#: Bits of a hash, and bits that a round looks ahead in buckets that are still too large.
BITS, AHEAD = 60, 6


def hash_bits(key: Column) -> Column:
    """60 bits of a key's MD5 as a long: any engine computes the same; null counts as an empty key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col("h"), (F.lit(BITS) - depth).cast("int"))


def extendible_shards(rows: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """``rows`` with ``shard, local_depth, shard_bytes, page``: the bucket of each row's key.

    A bucket at depth d has the keys whose first d hash bits are its prefix. It splits on one more bit
    while its rows have more than ``limit`` bytes, and no other bucket splits. Sizes are summed for
    prefixes some bits ahead of the mean depth, and a prefix's leaf is the shallowest ancestor within
    the limit; only buckets still too large there go into another round with more bits. ``shard`` is the
    prefix as a bit string (empty for one bucket). Rows that equal hashes keep together at all 60 bits,
    such as one key with too many rows, overflow into pages: ``page`` numbers them, each with ``limit``
    bytes at most, and between equal rows too; it is 0 elsewhere. A row above half the limit has a page
    to itself, whatever its size. A null size is 0.
    """
    if clash := {"h", "shard", "local_depth", "shard_bytes", "page"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them")
    bytes_ = F.coalesce(F.col(size).cast("long"), F.lit(0))
    sizes = keep(rows.select(hash_bits(F.col(key)).alias("h"), bytes_.alias("b")).groupBy("h").agg(F.sum("b").alias("b")), "sizes")
    total = sizes.agg(F.sum("b")).first()[0] or 0
    leaves, open_, done = None, sizes, 0
    deep = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    while True:
        cells = keep(open_.groupBy(_prefix(deep).alias("cell")).agg(F.sum("b").alias("b")), "cells")
        nodes = cells.select("cell", "b", F.explode(F.sequence(F.lit(done), F.lit(deep))).alias("d")).select("d", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("d")).cast("int")).alias("p"), "b").groupBy("d", "p").agg(F.sum("b").alias("b"))
        fits = nodes.filter((F.col("b") <= limit) | (F.col("d") == BITS))
        # Shallowest fitting ancestor: its parent doesn't fit, or it is a root of this round.
        big = nodes.filter(F.col("b") > limit).select((F.col("d") + 1).alias("d"), F.col("p").alias("up"))
        leaf = fits.join(big, (fits.d == big.d) & (F.expr("shiftright(p, 1)") == F.col("up")), "left").filter((fits.d == done) | F.col("up").isNotNull()).select(fits.d.alias("d"), "p", "b")
        leaf = keep(leaf, "leaves")
        leaves = leaf if leaves is None else leaves.union(leaf)
        over = keep(cells.filter(F.col("b") > limit).select("cell"), "over") if deep < BITS else None
        if over is None or over.isEmpty():
            break
        open_ = open_.join(over, _prefix(deep) == F.col("cell"), "left_semi")
        done, deep = deep + 1, min(BITS, deep + AHEAD)
    depths = [r[0] for r in leaves.select("d").distinct().orderBy("d").collect()]
    out = rows.withColumn("h", hash_bits(F.col(key)))
    at = out.withColumn("__at", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), _prefix(d).alias("p")) for d in depths)))) if len(depths) > 1 else out.withColumn("__at", F.struct(F.lit(depths[0] if depths else 0).alias("d"), _prefix(depths[0] if depths else 0).alias("p")))
    named = leaves.select(F.struct("d", "p").alias("__leaf"), F.col("b").alias("shard_bytes"))
    placed = at.join(named, F.col("__at") == F.col("__leaf")).withColumn("local_depth", F.col("__at.d").cast("int"))
    shard = F.when(F.col("local_depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(F.col("__at.p")), F.col("local_depth"), F.lit("0")))
    placed = placed.withColumn("shard", shard)
    return _paged(placed.drop("__at", "__leaf"), bytes_, limit).drop("h").select(*rows.columns, "shard", "local_depth", "shard_bytes", "page")


def _paged(placed: DataFrame, bytes_: Column, limit: int) -> DataFrame:
    """Numbers the overflow pages of buckets that no bit can split; rows are spread by salt, and pages never span salts."""
    salted = placed.withColumn("__over", F.col("shard_bytes") > limit)
    whole = salted.filter(~F.col("__over")).withColumn("page", F.lit(0).cast("long")).drop("__over")
    return whole.unionByName(_overflow(salted.filter("__over").drop("__over"), bytes_, limit))


def _overflow(rows: DataFrame, bytes_: Column, limit: int) -> DataFrame:
    """Pages of rows that no bit parts: rows are numbered where they are written, and salted by that number.

    The written table makes a row's number the same whenever it is read. Rows of up to half the limit
    fill pages of up to another half before the last of them.
    """
    numbered = keep(rows.withColumn("__n", F.monotonically_increasing_id()), "overflow")
    salt = F.pmod(F.xxhash64("__n"), F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / (64 * limit))))
    spread = numbered.withColumn("__salt", salt).withColumn("__own", bytes_ * 2 > limit)
    w = Window.partitionBy("shard", "__salt", "__own").orderBy("__n")
    before = F.coalesce(F.sum(bytes_).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = F.when(F.col("__own"), F.row_number().over(w) + (1 << 19)).otherwise(F.floor(before / (limit - limit // 2)))
    return spread.withColumn("page", (page + F.col("__salt") * (1 << 20)).cast("long")).drop("__salt", "__own", "__n")


def directory(shards: DataFrame) -> DataFrame:
    """The directory of the result of ``extendible_shards``: one row per bucket with its slots ``first_slot`` to ``last_slot``.

    The directory's global depth is the largest local one; a bucket of depth d fills 2**(global - d) slots.
    Buckets without rows, the empty halves of splits, have no row.
    """
    buckets = shards.select("shard", "local_depth", "shard_bytes").distinct()
    depth = buckets.agg(F.max("local_depth").alias("global_depth"))
    free = F.col("global_depth") - F.col("local_depth")
    first = F.coalesce(F.conv("shard", 2, 10).cast("long"), F.lit(0))
    span = F.call_function("shiftleft", F.lit(1).cast("long"), free)
    return buckets.join(F.broadcast(depth)).select("shard", "local_depth", "shard_bytes", "global_depth", (first * span).alias("first_slot"), (first * span + span - 1).alias("last_slot"))
