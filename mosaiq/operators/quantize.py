"""Vector quantization, k-means and codebooks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import pairwise
from .pairing import bytes_of

#: Fixed value added to the smallest squared distance of soft weights.
EPSILON = 1e-9
#: Bytes of a codebook, or of all codebooks that are learned together, at most.
BOOK_BYTES = 64 << 20


def square_distance(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: (x - y) * (x - y))


def _codes(codebook: DataFrame) -> DataFrame:
    """The codebook ``code, centroid`` as one row, which is broadcast; of more than ``BOOK_BYTES`` it is an error."""
    if bytes_of(codebook) > BOOK_BYTES:
        raise ValueError("a codebook too large to be broadcast")
    return codebook.agg(F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("book"))


def all_distances(rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """``i, code, d2`` of each row ``i, v`` and code."""
    each = rows.select("i", "v").join(F.broadcast(_codes(codebook)))
    d = F.transform("book", lambda c: F.struct(c["code"].alias("code"), square_distance(F.col("v"), c["centroid"]).alias("d2")))
    return each.select("i", F.inline(d))


def assign(rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """Adds the nearest code to each row with ``v``, ties to the smaller code: no shuffle."""
    d = F.transform("book", lambda c: F.struct(square_distance(F.col("v"), c["centroid"]).alias("d2"), c["code"].alias("code")))
    return rows.join(F.broadcast(_codes(codebook))).withColumn("code", F.array_min(d)["code"]).drop("book")


def soft_assign(rows: DataFrame, codebook: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``i, code, weight``: exp(-alpha d2 / (1e-9 + smallest d2)), normalised by row. All within the row."""
    each = rows.join(F.broadcast(_codes(codebook))).withColumn("d", F.transform("book", lambda c: square_distance(F.col("v"), c["centroid"])))
    low = F.array_min("d")
    e = each.withColumn("e", F.transform("d", lambda x: F.exp(-alpha * x / (EPSILON + low))))
    s = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    w = F.zip_with("book", "e", lambda c, x: F.struct(c["code"].alias("code"), (x / s).alias("weight")))
    return e.select("i", F.inline(w))


def histogram(assigned: DataFrame, by: str) -> DataFrame:
    """``by, code, share`` of hard assignments."""
    n = assigned.groupBy(by, "code").agg(F.count("*").alias("n"))
    return n.select(by, "code", (F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("share"))


def kmeans_step(rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """One step of Lloyd's algorithm: the mean of each code's rows; a code without rows keeps its centroid."""
    parts = assign(rows, codebook).select("code", F.posexplode("v").alias("j", "x")).groupBy("code", "j").agg(F.avg("x").alias("m"))
    new = parts.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("new"))
    return codebook.join(new, "code", "left").select("code", F.coalesce("new", "centroid").alias("centroid"))


def kmeans(rows: DataFrame, codebook: DataFrame, steps: int = 20) -> DataFrame:
    """Lloyd steps from a given codebook; the small codebook goes through the driver, which cuts the lineage."""
    spark, schema = rows.sparkSession, codebook.schema
    for _ in range(steps):
        before = codebook.collect()
        after = kmeans_step(rows, codebook).orderBy("code").collect()
        codebook = spark.createDataFrame(after, schema)
        if sorted(before) == sorted(after):
            break
    return codebook


def iterative_kmeans(rows: DataFrame, k: int, alpha: float = 0.1, steps: int = 20) -> DataFrame:
    """Codebook of k codes: starts at the mean, and splits the largest cluster along its first singular vector.

    Of that cluster only its Gram matrix, aggregated by Spark, reaches the driver.
    """
    spark = rows.sparkSession
    n = rows.select(F.size("v")).first()[0]
    mean = rows.select(*(F.avg(F.col("v")[j]) for j in range(n))).first()
    centroids = [list(map(float, mean))]
    make = lambda c: spark.createDataFrame(list(enumerate(c)), "code int, centroid array<double>")
    while len(centroids) < k:
        got = assign(rows, make(centroids))
        largest = got.groupBy("code").count().orderBy(F.desc("count"), "code").first()["code"]
        x = got.filter(F.col("code") == largest).select("v")
        cells = x.select(F.posexplode("v").alias("a", "x"), "v").select("a", "x", F.posexplode("v").alias("b", "y")).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()
        gram = np.zeros((n, n))
        for r in cells:
            gram[r["a"], r["b"]] = r["s"]
        value, vector = np.linalg.eigh(gram)
        shift = alpha * np.sqrt(np.sqrt(max(value[-1], 0.0))) * vector[:, -1]
        at = np.array(centroids[largest])
        centroids[largest : largest + 1] = [(at + shift).tolist(), (at - shift).tolist()]
        centroids = [list(r["centroid"]) for r in kmeans(rows, make(centroids), steps).orderBy("code").collect()]
    return make(centroids)


@dataclass
class Codebooks:
    """Codebooks of several keys, several starts of each: centroids (starts x codes x d) by key, NaN where a start has fewer codes."""

    books: dict[object, np.ndarray]

    def frame(self, spark: SparkSession, key: str, kind: str, start: int | None = None) -> DataFrame:
        """``key, start, code, centroid``."""
        rows = [(k, s, c, list(map(float, v))) for k, b in self.books.items() for s, book in enumerate(b) for c, v in enumerate(book) if not np.isnan(v).any() and start in (None, s)]
        return spark.createDataFrame(rows, f"{key} {kind}, start int, code int, centroid array<double>")


def _grouped(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """Each key of a batch with the places of its rows and their vectors."""
    if not batch.num_rows:
        return
    of = batch.column(key).dictionary_encode()
    v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
    at = of.indices.to_numpy()
    for k, name in enumerate(of.dictionary.to_pylist()):
        own = np.flatnonzero(at == k)
        yield name, own, v[own]


def _square(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows and codes; a code that isn't there is infinitely far."""
    step = max(1, (1 << 22) // max(1, book.size))
    d = np.concatenate([((v[k : k + step, None, :] - book[None]) ** 2).sum(2) for k in range(0, len(v), step)])
    return np.where(np.isnan(d), np.inf, d)


def random_starts(rows: DataFrame, key: str, k: int, starts: int, seed: int = 0) -> Codebooks:
    """For each key and start ``k`` of the key's distinct vectors, drawn by a hash: the same ones on every run.

    Each task keeps the ``k`` lowest hashes of each key and start, so that what is shuffled is bounded by the model.
    """
    kind = rows.schema[key].dataType

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, list[dict[int, bytes]]] = {}
        for batch in batches:
            for name, _, v in _grouped(batch, key):
                held = best.setdefault(name, [{} for _ in range(starts)])
                new = {x.tobytes() for x in v}
                for s in range(starts):
                    salt = f"{seed} {s} ".encode()
                    both = held[s] | {int.from_bytes(hashlib.blake2b(salt + x, digest_size=8).digest(), "little") >> 1: x for x in new}
                    held[s] = {h: both[h] for h in sorted(both)[:k]}
        flat = [(name, s, h, np.frombuffer(x).tolist()) for name, held in best.items() for s, of in enumerate(held) for h, x in of.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], to_arrow_type(kind)), pa.array([r[1] for r in flat], pa.int32()), pa.array([r[2] for r in flat], pa.int64()), pa.array([r[3] for r in flat], pa.list_(pa.float64()))], names=[key, "start", "h", "v"])

    few = rows.select(key, "v").mapInArrow(lowest, f"{key} {kind.simpleString()}, start int, h long, v array<double>")
    first = few.distinct().groupBy(key, "start").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "v"))), 1, k).alias("c"))
    books: dict[object, np.ndarray] = {}
    for r in first.collect():
        c = np.array([x["v"] for x in r["c"]])
        books.setdefault(r[key], np.full((starts, k, c.shape[1]), np.nan))[r["start"], : len(c)] = c
    return Codebooks(books)


def keyed_kmeans_step(rows: DataFrame, key: str, model: Codebooks) -> tuple[Codebooks, dict[object, np.ndarray]]:
    """One step of Lloyd's algorithm for all keys and starts, in one reading of ``rows(key, v)``; and the mean distance before it, by key and start.

    Each task assigns its rows to the codes of their key and adds up vectors, numbers and distances by key,
    start and code; these sums, as large as the model, are added up by Spark. A code without rows keeps its place.
    """
    held = rows.sparkSession.sparkContext.broadcast(model.books)
    kind = rows.schema[key].dataType

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            for name, _, v in _grouped(batch, key):
                book = held.value[name]
                sums = total.setdefault(name, np.zeros((*book.shape[:2], book.shape[2] + 2)))
                for s in range(len(book)):
                    d = _square(v, book[s])
                    code = d.argmin(1)
                    each = np.column_stack([v, np.ones(len(v)), np.sqrt(d[np.arange(len(v)), code])])
                    for j in range(each.shape[1]):
                        sums[s, :, j] += np.bincount(code, each[:, j], minlength=book.shape[1])
        flat = [(name, s, c, sums[s, c].tolist()) for name, sums in total.items() for s in range(len(sums)) for c in range(sums.shape[1]) if sums[s, c, -2]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], to_arrow_type(kind)), pa.array([r[1] for r in flat], pa.int32()), pa.array([r[2] for r in flat], pa.int32()), pa.array([r[3] for r in flat], pa.list_(pa.float64()))], names=[key, "start", "code", "sums"])

    parts = rows.select(key, "v").mapInArrow(summed, f"{key} {kind.simpleString()}, start int, code int, sums array<double>")
    each = parts.select(key, "start", "code", F.posexplode("sums").alias("j", "x")).groupBy(key, "start", "code", "j").agg(F.sum("x").alias("x"))
    found = each.groupBy(key, "start", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("sums"))
    books, far, count = {n: b.copy() for n, b in model.books.items()}, {n: np.zeros(len(b)) for n, b in model.books.items()}, dict.fromkeys(model.books, 0.0)
    for r in found.collect():  # a row for each code
        *x, n, d = r["sums"]
        books[r[key]][r["start"], r["code"]] = np.array(x) / n
        far[r[key]][r["start"]] += d
        if r["start"] == 0:
            count[r[key]] += n
    return Codebooks(books), {n: d / max(count[n], 1.0) for n, d in far.items()}


def keyed_kmeans(rows: DataFrame, key: str, k: int, starts: int = 20, steps: int = 100, tol: float = 1e-5, seed: int = 0, model: Codebooks | None = None) -> tuple[Codebooks, dict[object, float]]:
    """The best of several k-means of each key's vectors ``v``: codebooks with one start, and their mean distances.

    All keys and starts are one model: a step reads the rows once and makes one aggregation, however many there
    are. A start is settled once its mean distance falls by ``tol`` at most; the steps go on until all are. The
    one with the least mean distance stays, the first of equal ones. The codebooks, which are broadcast and come to the
    driver, have at most ``BOOK_BYTES`` together; more is an error.
    """
    model = random_starts(rows, key, k, starts, seed) if model is None else model
    if sum(b.nbytes for b in model.books.values()) > BOOK_BYTES:
        raise ValueError("codebooks too large to be learned together")
    settled: dict[object, np.ndarray] = {n: np.zeros(len(b), bool) for n, b in model.books.items()}
    last = {n: np.full(len(b), np.inf) for n, b in model.books.items()}
    for _ in range(steps):
        after, far = keyed_kmeans_step(rows, key, model)
        for n in model.books:
            settled[n] |= last[n] - far[n] <= tol
            last[n] = np.where(settled[n], np.minimum(last[n], far[n]), far[n])
            after.books[n][settled[n]] = model.books[n][settled[n]]
        model = after
        if all(x.all() for x in settled.values()):
            break
    best = {n: int(d.argmin()) for n, d in last.items()}
    return Codebooks({n: model.books[n][best[n]][None] for n in best}), {n: float(last[n][best[n]]) for n in best}


def keyed_assign(rows: DataFrame, key: str, model: Codebooks, soft: float | None = None) -> DataFrame:
    """The rows without ``v``, with ``code, weight``: the nearest code of their key's codebook with weight 1, or all codes with weights by distance.

    ``soft`` is alpha in exp(-alpha d2 / (1e-9 + smallest d2)), normalised by row.
    """
    held = rows.sparkSession.sparkContext.broadcast({n: b[0] for n, b in model.books.items()})
    rest = [c for c in rows.columns if c != "v"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own, v in _grouped(batch, key):
                d = _square(v, held.value[name])
                if soft is None:
                    row, code, weight = np.arange(len(v)), d.argmin(1), np.ones(len(v))
                else:
                    e = np.exp(-soft * d / (EPSILON + d.min(1, keepdims=True)))
                    row, code = np.nonzero(np.isfinite(d))
                    weight = (e / e.sum(1, keepdims=True))[row, code]
                kept = batch.select(rest).take(pa.array(own[row]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(code, pa.int32()), pa.array(weight, pa.float64())], names=[*rest, "code", "weight"])

    return rows.mapInArrow(assigned, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), "code int", "weight double"]))


def build_codebook(rows: DataFrame, k: int, mode: str = "iterative", seed: int = 0) -> DataFrame:
    """``iterative`` splits; ``raw`` is the k-means of pyspark.ml."""
    if mode == "iterative":
        return iterative_kmeans(rows, k)
    if mode != "raw":
        raise ValueError(f"mode {mode}")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="f").fit(rows.select(array_to_vector("v").alias("f")))
    return rows.sparkSession.createDataFrame([(c, list(map(float, v))) for c, v in enumerate(model.clusterCenters())], "code int, centroid array<double>")


def whitened(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns divided by their population deviation over all rows; constant columns stay."""
    dev = rows.agg(*(F.stddev_pop(c).alias(f"__{c}") for c in columns))
    out = rows.join(F.broadcast(dev))
    for c in columns:
        out = out.withColumn(c, F.col(c) / F.when(F.col(f"__{c}") == 0, 1.0).otherwise(F.col(f"__{c}")))
    return out.drop(*(f"__{c}" for c in columns))
