"""Approximate nearest neighbours by vantage-point trees, one per shard, with relaxed triangle pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Rows of a shard, about; rows of a leaf; queries of a block.
SHARD_ROWS, LEAF, BLOCK = 8192, 128, 2048
#: Of a branch's triangle bound, the part that must be within the tenth distance so far; see the README for recall.
FACTOR = 0.2


class Tree:
    """A vantage-point tree in arrays. Equal vectors are one point with its ids in order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.points, of = np.unique(points, axis=0, return_inverse=True) if len(points) else (points, np.zeros(0, np.int64))
        order = np.lexsort((ids, of))
        self.ids, count = ids[order], np.bincount(of, minlength=len(self.points))
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.norm = (self.points**2).sum(1)
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(self.points)), leaf, rng) if len(points) else None

    def _build(self, at: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(at) <= leaf:
            self.nodes.append(("leaf", at))
            return len(self.nodes) - 1
        # The vantage point of a few whose distances to a few points spread most.
        some = rng.choice(at, min(len(at), 8), replace=False)
        probe = rng.choice(at, min(len(at), 64), replace=False)
        spread = [np.linalg.norm(self.points[probe] - self.points[s], axis=1).std() for s in some]
        vantage = some[int(np.argmax(spread))]
        d = np.linalg.norm(self.points[at] - self.points[vantage], axis=1)
        half = len(at) // 2
        by = np.argsort(d, kind="stable")
        inner, outer = by[:half], by[half:]
        node = len(self.nodes)
        self.nodes.append(None)
        bounds = d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]]
        self.nodes[node] = ("split", vantage, bounds, self._build(at[inner], leaf, rng), self._build(at[outer], leaf, rng))
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest of the shard, but for its own id; inf and -1 where there are fewer.

        A branch is left out for a query if factor times its k-th distance so far is below the smallest
        distance that the triangle inequality leaves for the branch: factor 1 is exact, and smaller
        factors leave out more. All queries go down the tree together, nearer branch first.
        """
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.q, self.qid, self.k, self.factor = queries, query_ids, k, factor
        self.qnorm = (queries**2).sum(1)
        self.visited = 0
        if self.root is not None and len(queries):
            self._down(self.root, np.arange(len(queries)), np.zeros(len(queries)))
        return self.best, self.found

    def _down(self, node: int, who: np.ndarray, bound: np.ndarray) -> None:
        who = who[bound <= self.factor * self.best[who, -1] * (1 + 1e-9)]
        if not len(who):
            return
        kind, *rest = self.nodes[node]
        if kind == "leaf":
            self._leaf(rest[0], who)
            return
        vantage, (a, b, c, e), inner, outer = rest
        d = np.linalg.norm(self.q[who] - self.points[vantage], axis=1)
        low_in = np.maximum(np.maximum(a - d, d - b), 0)
        low_out = np.maximum(np.maximum(c - d, d - e), 0)
        near = d <= (b + c) / 2
        self._down(inner, who[near], low_in[near])
        self._down(outer, who, low_out) if not near.any() else self._down(outer, who[~near], low_out[~near])
        if near.any():
            self._down(outer, who[near], low_out[near])
        self._down(inner, who[~near], low_in[~near])

    def _leaf(self, at: np.ndarray, who: np.ndarray) -> None:
        self.visited += len(at) * len(who)
        for part in np.array_split(who, -(-len(who) // 512)):
            # The fast form only chooses; what is kept is measured exactly, with room for its rounding.
            fast = np.sqrt(np.maximum(self.qnorm[part, None] + self.norm[at] - 2 * (self.q[part] @ self.points[at].T), 0))
            row, col = np.nonzero(fast <= self.best[part, -1:] + 1e-6)
            exact = np.sqrt(((self.q[part[row]] - self.points[at[col]]) ** 2).sum(1))
            point = at[col]
            copies = np.minimum(self.first[point + 1] - self.first[point], self.k + 1)
            pick = np.repeat(np.arange(len(row)), copies)
            nth = np.arange(len(pick)) - np.repeat(np.cumsum(copies) - copies, copies)
            ids, row, exact = self.ids[self.first[point[pick]] + nth], row[pick], exact[pick]
            other = ids != self.qid[part[row]]
            ids, row, exact = ids[other], row[other], exact[other]
            n = len(part)
            row = np.concatenate([row, np.repeat(np.arange(n), self.k)])
            exact = np.concatenate([exact, self.best[part].ravel()])
            ids = np.concatenate([ids, self.found[part].ravel()])
            by = np.lexsort((ids, exact, row))
            row, exact, ids = row[by], exact[by], ids[by]
            first = np.searchsorted(row, np.arange(n))
            take = first[:, None] + np.arange(self.k)
            self.best[part], self.found[part] = exact[take], ids[take]


def usable(vector: Column) -> Column:
    """True for vectors that take part: neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, queries: Column, k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``rows(vec_id, embedding)`` that ``queries`` holds for, its k nearest others.

    Rows are dealt to shards by a hash of their id, so that equal vectors spread, and every shard has
    its own tree over all its rows. The queries go to the shards in blocks; a task builds one tree and
    searches it for one block after another. The k best of each query from every shard meet in one
    aggregation. Scores are Euclidean distances in double precision; ties go to the smaller id. Vectors
    that are null, zero or not finite take no part, and vectors of different lengths don't meet. An id
    that occurs twice is two rows to be found and one query, the smaller vector's; a query never finds a
    row with its own id.
    """
    base = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    base = base.withColumn("dims", F.size("v"))
    n = base.count()
    shards = max(1, -(-n // shard_rows))
    asked = base.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    packed = asked.groupBy("dims", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"), "dims", "block", "ids", "vs")
    held = base.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("part"), "dims", F.lit(-1).alias("block"), F.array("vec_id").alias("ids"), F.col("v").alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, points, tree = None, [], [], None
        for batch in batches:
            for shard, part, dims, mine, v in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), batch.column("dims").to_pylist(), batch.column("ids"), batch.column("vs"), strict=True):
                if (shard, dims) != now:
                    now, ids, points, tree = (shard, dims), [], [], None
                mine, v = mine.values.to_numpy(), v.values.to_numpy()
                if part == 0:
                    ids.append(mine)
                    points.append(v)
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids), np.concatenate(points).reshape(-1, dims)) if ids else Tree(np.zeros(0, np.int64), np.zeros((0, dims)))
                best, found = tree.search(mine, v.reshape(-1, dims), k, factor)
                row, col = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(found[row, col]), pa.array(best[row, col])], names=["query_id", "vec_id", "score"])

    work = held.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "dims", "part")
    near = work.mapInArrow(run, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
