"""Conflict-constrained best-fit packing of texts into fixed-size sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import Rule, jaccard_components, numbered
from .scratch import keep


class Bins:
    """Open bins ordered by what is left in them, with bitmaps of their sources and duplicate clusters.

    ``levels`` are the amounts left that some bin has, in order. A level also has the bits that all its
    bins carry, so that the successor search passes over a level at once where no bin can be compatible.
    """

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.levels: list[int] = []
        self.at: dict[int, list[list[int]]] = {}
        self.shared: dict[int, int] = {}

    def take(self, size: int, bits: int) -> tuple[int, int]:
        """The bin, and the offset in it, of an item: the tightest bin that has room and none of its bits."""
        for k in range(bisect_left(self.levels, size), len(self.levels)):
            left = self.levels[k]
            if self.shared[left] & bits:
                continue
            for i, (number, taken) in enumerate(self.at[left]):
                if not taken & bits:
                    self._remove(k, left, i)
                    self._put(number, left - size, taken | bits)
                    return number, self.capacity - left
        self.count += 1
        self._put(self.count - 1, self.capacity - size, bits)
        return self.count - 1, 0

    def _remove(self, k: int, left: int, i: int) -> None:
        bins = self.at[left]
        del bins[i]
        if not bins:
            del self.at[left], self.shared[left], self.levels[k]
            return
        if len(bins) <= 64:  # above that, the bits that were shared before still are
            every = -1
            for _, taken in bins:
                every &= taken
            self.shared[left] = every

    def _put(self, number: int, left: int, taken: int) -> None:
        if left == 0:
            return
        if left not in self.at:
            insort(self.levels, left)
            self.at[left], self.shared[left] = [], -1
        self.at[left].append([number, taken])
        self.shared[left] &= taken


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int]]:
    """``item, bin, offset, size`` of every piece: items above the capacity fill whole bins first, then pieces go largest first.

    Two pieces of one source, or of one duplicate cluster, never share a bin. Null is no source and no cluster.
    """
    counts = [Counter(x for x in column if x is not None) for column in (sources, clusters)]
    bit: dict[tuple, int] = {}
    bins, out, rest = Bins(capacity), [], []
    for i, size in enumerate(sizes):
        while size > capacity:
            out.append((i, bins.count, 0, capacity))
            bins.count += 1
            size -= capacity
        if size or not sizes[i]:
            rest.append((-size, i))
    for size, i in sorted(rest):
        mask = 0
        for kind, x in enumerate((sources[i], clusters[i])):
            if x is not None and counts[kind][x] > 1:
                mask |= 1 << bit.setdefault((kind, x), len(bit))
        number, offset = bins.take(-size, mask)
        out.append((i, number, offset, -size))
    return out


PIECES = "doc_id long, piece int, shard int, bin long, bin_offset long, n_bytes long"


def packed(docs: DataFrame, size: Column, cluster: Column, capacity: int, shard_bytes: int = 48 << 20, total: int | None = None) -> DataFrame:
    """One row per piece of a document: its shard, its bin there, its place and its size.

    Documents are dealt to shards by a hash of their key and text, some tens of megabytes each, so that
    no source or cluster makes a shard large; each shard is packed by itself with ``pack``. Sizes are
    what the caller measures (bytes, tokens); an empty or null text has one piece of size 0, a null
    source or cluster constrains nothing. ``total`` is the sum of the sizes where the caller has it.
    """
    measured = docs.select("doc_id", *_measures(size), cluster.alias("cluster"))
    if total is None:
        total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    return _packed(measured, capacity, shard_bytes, total)


def packed_apart(docs: DataFrame, size: Column, capacity: int, rule: Rule = Rule(size=5, percent=80), shard_bytes: int = 48 << 20) -> DataFrame:
    """``packed`` where the near copies that ``rule`` links, without case, are one cluster; texts without words are in none.

    Each row is a node of the join, also where ids are null or repeated. Texts don't go through the join
    with the clusters, only what is measured of them.
    """
    rows, key = numbered(docs)
    found = jaccard_components(rows.select(F.col(key).alias("doc_id"), F.lower("text").alias("text")), rule)
    clusters = found.filter("n_shingles > 0").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("cluster"))
    measures = keep(rows.select(F.col(key).alias("__key"), "doc_id", *_measures(size)), "measures")
    total = measures.agg(F.sum("size")).first()[0] or 0
    return _packed(measures.join(clusters, "__key", "left"), capacity, shard_bytes, total)


def _measures(size: Column) -> list[Column]:
    return [F.col("source"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("deal")]


def _packed(measured: DataFrame, capacity: int, shard_bytes: int, total: int) -> DataFrame:
    """Packs ``measured(doc_id, source, size, deal, cluster)``, whose sizes make ``total``."""
    shards = max(1, -(-total // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        now = None

        def solved() -> pa.RecordBatch:
            got = pack(held[1], held[2], held[3], capacity)
            seen: Counter = Counter()
            rows = []
            for i, number, offset, n in got:
                rows.append((held[0][i], seen[i], now, number, offset, n))
                seen[i] += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for shard, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if shard != now and now is not None:
                    yield solved()
                    held = [[], [], [], []]
                now = shard
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        if now is not None:
            yield solved()

    dealt = measured.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int")).repartition(shards, "shard")
    return dealt.sortWithinPartitions("shard", "doc_id", "deal").select("shard", "doc_id", "size", "source", "cluster").mapInArrow(run, PIECES)


def text_cluster(text: Column) -> Column:
    """The cluster of texts that equal one another but for case and white space; null for an empty text."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.length(plain) > 0, F.xxhash64(plain))
