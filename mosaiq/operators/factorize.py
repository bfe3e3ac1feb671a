"""Non-negative matrix factorization under the generalized Kullback-Leibler divergence, and learning over several modalities."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def product_at(x: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """``i, j, x, wh``: the product W H at X's cells only. ``w(i, k, w)``, ``h(k, j, h)``."""
    return x.join(w, "i").join(h, ["k", "j"]).groupBy("i", "j").agg(F.first("x").alias("x"), F.sum(F.col("w") * F.col("h")).alias("wh"))


def ratios(x: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """``i, j, q``: (x + eps) / (wh + eps) at X's cells."""
    return product_at(x, w, h).select("i", "j", ((F.col("x") + EPS) / (F.col("wh") + EPS)).alias("q"))


def updated_w(q: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """W times (Q H'), without a denominator."""
    g = q.join(h, "j").groupBy("i", "k").agg(F.sum(F.col("q") * F.col("h")).alias("g"))
    return w.join(g, ["i", "k"]).select("i", "k", (F.col("w") * F.col("g")).alias("w"))


def updated_h(q: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """H times (W' Q) with rows divided by their sums; q is from before W was updated."""
    g = q.join(w, "i").groupBy("k", "j").agg(F.sum(F.col("q") * F.col("w")).alias("g"))
    new = h.join(g, ["k", "j"]).select("k", "j", (F.col("h") * F.col("g")).alias("h"))
    return new.join(new.groupBy("k").agg(F.sum("h").alias("s")), "k").select("k", "j", (F.col("h") / (F.col("s") + 1e-16)).alias("h"))


def error(x: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """The divergence of X from W H; W H is summed through its factors' sums and never made."""
    cells = product_at(x, w, h).agg(F.sum(F.col("x") * F.ln((F.col("x") + EPS) / (F.col("wh") + EPS)) - F.col("x")).alias("a"))
    sums = w.groupBy("k").agg(F.sum("w").alias("sw")).join(h.groupBy("k").agg(F.sum("h").alias("sh")), "k").agg(F.sum(F.col("sw") * F.col("sh")).alias("b"))
    return cells.join(F.broadcast(sums)).select((F.col("a") + F.col("b")).alias("error"))


@dataclass
class Model:
    """A dictionary (k x d) with the errors before each update."""

    h: np.ndarray
    errors: list[float]


def start_dictionary(k: int, d: int, seed: int = 0) -> np.ndarray:
    h = np.random.default_rng(seed).random((k, d)) + 0.01
    return h / h.sum(1, keepdims=True)


# -- passes over rows that stay where they are

#: Cells of the data that a task takes at a time; numbers of a sum that meet in one row; bytes of the dictionaries of one pass.
CELLS, PART, MODEL_BYTES = 1 << 16, 1 << 16, 64 << 20
#: Bytes of a bucket's rows.
BUCKET_BYTES = 128 << 20


def _stored(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` as a table with a file for each bucket of ``i`` that a task holds."""
    name = f"mosaiq_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "i").saveAsTable(name)
    table = df.sparkSession.table(name)
    table._stored_as, table._buckets = name, buckets
    return table


def _dropped(*tables: DataFrame | None) -> None:
    for table in tables:
        if table is not None:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.__dict__['_stored_as']}")


def sparse(v: Column) -> tuple[Column, Column]:
    """Places and values of an array's cells that aren't zero; null counts as zero."""
    cells = F.filter(F.transform(v, lambda x, j: F.struct(j.alias("j"), x.cast("double").alias("x"))), lambda c: c["x"] != 0)
    return cells["j"].alias("idx"), cells["x"].alias("x")


def placed(rows: DataFrame, models: Column | None = None) -> DataFrame:
    """The rows ``i`` and ``v``, or ``idx, x``, as a bucketed table ``i, idx, x, models`` of sparse rows: the one time that they are shuffled.

    ``models`` are the numbers of the models that a row takes part in, [0] if not given. ``i`` is distinct
    and not null. A bucket has about ``BUCKET_BYTES``.
    """
    idx, x = (F.col("idx"), F.col("x")) if "x" in rows.columns else sparse(F.col("v"))
    key = F.when(F.col("i").isNotNull(), F.col("i")).otherwise(F.raise_error(F.lit("a row without i")).cast("long"))
    data = rows.select(key.cast("long").alias("i"), idx, x, (F.array(F.lit(0)) if models is None else models).cast("array<int>").alias("models"))
    size = data.agg(F.sum(12 * F.size("x"))).first()[0] or 0
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    return _stored(data.repartition(buckets, "i"), buckets)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Kernel:
    """One update of some rows under the dictionaries that they take part in."""

    def __init__(self, h: np.ndarray, active: list[bool], fit: bool):
        self.h, self.active, self.fit = h, active, fit
        self.mass = h.sum(2)
        self.g, self.err = np.zeros_like(h) if fit else None, np.zeros(len(h))

    def update(self, size: np.ndarray, idx: np.ndarray, x: np.ndarray, many: np.ndarray, model: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        """New coefficients of each row and model; rows have ``size`` cells and ``many`` models."""
        if len(x) and (x.min() < 0 or not np.isfinite(x).all()):
            raise ValueError("negative or not finite")
        row, first = np.repeat(np.arange(len(size)), many), np.cumsum(size) - size
        new = np.zeros((len(row), self.h.shape[1]))
        for m in np.unique(model):
            own = np.flatnonzero(model == m)
            n = size[row[own]]
            cell = _ranges(first[row[own]], n)
            of, value, h = np.repeat(np.arange(len(own)), n), x[cell], self.h[m][:, idx[cell]]
            some = np.flatnonzero(n)
            start = (np.cumsum(n) - n)[some]

            def by_row(cells: np.ndarray, some=some, start=start, n=len(own)) -> np.ndarray:
                out = np.zeros((n, len(cells)))
                if len(some):
                    out[some] = np.add.reduceat(cells, start, axis=1).T
                return out

            old = by_row(value * h) if w is None else w[own]
            if not self.active[m]:
                new[own] = old
                continue
            wh = np.einsum("ck,kc->c", old[of], h)
            q = (value + EPS) / (wh + EPS)
            self.err[m] += (value * np.log(q) - value).sum() + old.sum(0) @ self.mass[m]
            new[own] = old * by_row(q * h)
            if self.fit and len(cell):
                order = np.argsort(idx[cell], kind="stable")
                j = idx[cell][order]
                begin = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
                self.g[m][:, j[begin]] += np.add.reduceat((new[own][of].T * q)[:, order], begin, axis=1)
        return new


def _pass(data: DataFrame, w: DataFrame | None, h: np.ndarray, active: list[bool], fit: bool) -> DataFrame:
    """``i, w`` of every row after one update, and in rows without ``i`` each task's sums ``part, task, g``: W'Q in parts, and the errors under part -1.

    Both tables have their buckets by ``i``, so that neither moves: a task joins its bucket of the data to
    its bucket of the coefficients, which it holds in memory.
    """
    held = data.sparkSession.sparkContext.broadcast((h, active, fit))
    k, begun = h.shape[1], w is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, names = _Kernel(*held.value), ["i", "w", "part", "task", "g"]
        for batch in batches:
            size = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False).astype(np.int64)
            end, low = np.cumsum(size), 0
            while low < len(size):
                high = max(low + 1, int(np.searchsorted(end, (end[low - 1] if low else 0) + CELLS, "right")))
                part = batch.slice(low, high - low)
                idx, x, model = (part.column(c).flatten().to_numpy() for c in ("idx", "x", "models"))
                many = pc.list_value_length(part.column("models")).to_numpy(zero_copy_only=False).astype(np.int64)
                before = part.column("w").flatten().to_numpy().reshape(-1, k) if begun else None
                new = kernel.update(size[low:high], idx, x, many, model, before)
                at = pa.array(np.concatenate([[0], np.cumsum(many * k)]).astype(np.int32))
                none = [pa.nulls(high - low, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.ListArray.from_arrays(at, pa.array(new.ravel())), *none], names=names)
                low = high
        task = TaskContext.get().partitionId()
        sums = {-1: kernel.err}
        if fit:
            g = kernel.g.ravel()
            sums |= {p: g[p * PART : (p + 1) * PART] for p in range(-(-len(g) // PART))}
        for p, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([p], pa.int32()), pa.array([task], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64()))], names=names)

    joined = data if w is None else data.join(w.filter("i IS NOT NULL").select("i", "w").hint("shuffle_hash"), "i")
    return joined.mapInArrow(run, "i long, w array<double>, part int, task int, g array<double>")


def _sums(out: DataFrame) -> dict[int, np.ndarray]:
    """A pass's sums by part, added up in tasks, in the order of the tasks that made them; the driver gets as much as the models have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "g"])
        for batch in batches:
            for part, g in zip(batch.column("part").to_pylist(), batch.column("g"), strict=True):
                values = g.values.to_numpy()
                if part == at:
                    total = total + values
                    continue
                if at is not None:
                    yield row()
                at, total = part, values
        if at is not None:
            yield row()

    parts = out.filter("i IS NULL").select("part", "task", "g").repartition("part").sortWithinPartitions("part", "task").select("part", "g")
    return {r.part: np.array(r.g) for r in parts.mapInArrow(run, "part int, g array<double>").collect()}


def _iterate(data: DataFrame, h: np.ndarray, steps: int, tol: float, fit: bool) -> tuple[np.ndarray, list[list[float]], list[DataFrame]]:
    """Updates of all models in one pass a step, until ``steps``, or for a model until its error, taken over its rows, falls by less than tol a cell.

    ``h`` is models x k x d. The result has the dictionaries, the errors before each update, and for each model
    the table with its coefficients.
    """
    buckets = data.__dict__["_buckets"]
    h, models = h.copy(), range(len(h))
    errors: list[list[float]] = [[] for _ in models]
    active, final = [True] * len(h), [None] * len(h)
    rows = dict(data.select(F.explode("models").alias("m")).groupBy("m").count().collect()) if tol else {}
    w = None
    for _ in range(steps):
        out = _stored(_pass(data, w, h, active, fit), buckets)
        sums = _sums(out)
        g = np.concatenate([sums[p] for p in sorted(sums) if p >= 0]).reshape(h.shape) if fit else None
        for m in models:
            if not active[m]:
                continue
            err = float(sums[-1][m])
            if errors[m] and errors[m][-1] - err < tol * rows.get(m, 0) * h.shape[2]:
                active[m], final[m] = False, w
                continue
            errors[m].append(err)
            if fit:
                new = h[m] * g[m]
                h[m] = new / (new.sum(1, keepdims=True) + 1e-16)
        if not any(active):
            _dropped(out)
            break
        if not any(w is f for f in final):
            _dropped(w)
        w = out
    if w is None and not fit:
        w = _stored(_pass(data, None, h, [False] * len(h), fit), buckets)
    return h, errors, [w if f is None else f for f in final]


def fit_models(rows: DataFrame, models: Column, h0: np.ndarray, steps: int = 200, tol: float = 1e-6) -> list[Model]:
    """Learns several dictionaries at once from rows ``i, v`` (or sparse ``i, idx, x``), each from the rows that name it in ``models``.

    ``h0`` (models x k x d) has the starts. However many models there are, a step reads the data once: each
    row is updated under every model that it takes part in, and each task adds up W'Q of all. Only the
    dictionaries' size reaches the driver. The data are shuffled once, when they are placed; a step's
    coefficients are written as a table with the same buckets. Models of more than ``MODEL_BYTES`` together
    are taken in several runs. Rows without models take no part.
    """
    data, out = placed(rows, models), []
    share = max(1, MODEL_BYTES // max(1, h0[0].nbytes))
    for low in range(0, len(h0), share):
        part = data if len(h0) <= share else _only(data, low, low + share)
        h, errors, tables = _iterate(part, h0[low : low + share], steps, tol, True)
        _dropped(*{id(t): t for t in tables}.values())
        out += [Model(x, e) for x, e in zip(h, errors, strict=True)]
        if part is not data:
            _dropped(part)
    _dropped(data)
    return out


def _only(data: DataFrame, low: int, high: int) -> DataFrame:
    """The table with the models from ``low`` on, which are numbered from 0."""
    own = F.transform(F.filter("models", lambda m: (m >= low) & (m < high)), lambda m: m - low)
    return placed(data.select("i", "idx", "x", own.alias("own")), F.col("own"))


def transform_models(rows: DataFrame, models: Column, h: np.ndarray, steps: int = 50, tol: float = 0.0) -> DataFrame:
    """``i, model, w``: each row's coefficients under each fixed dictionary (models x k x d) that it names; all in one pass a step."""
    data, k, out = placed(rows, models), h.shape[1], None
    share = max(1, MODEL_BYTES // max(1, h[0].nbytes))
    for low in range(0, len(h), share):
        part = data if len(h) <= share else _only(data, low, low + share)
        _, _, tables = _iterate(part, h[low : low + share], steps, tol, False)
        for table in {id(t): t for t in tables}.values():
            own = [m for m, t in enumerate(tables) if t is table]
            each = part.select("i", "models").join(table.filter("i IS NOT NULL").select("i", "w").hint("shuffle_hash"), "i").select("i", "w", F.posexplode("models").alias("at", "model"))
            got = each.filter(F.col("model").isin(own)).select("i", (F.col("model") + low).alias("model"), F.slice("w", F.col("at") * k + 1, k).alias("w"))
            out = got if out is None else out.unionByName(got)
    return out


def rescaled(w: DataFrame, h: np.ndarray, factors: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Coefficients ``i, w`` times the factors and the dictionary's rows over them: the product stays."""
    f = np.asarray(factors, float)
    if f.shape != (len(h),) or not (f > 0).all():
        raise ValueError("a positive factor for each row of the dictionary")
    return w.withColumn("w", F.zip_with("w", F.lit(f.tolist()), lambda x, y: x * y)), h / f[:, None]


def fit(rows: DataFrame, k: int | None = None, steps: int = 200, tol: float = 1e-6, h0: np.ndarray | None = None, seed: int = 0) -> Model:
    """Learns a dictionary from rows ``i, v``, or sparse ``i, idx, x`` with ``h0``: each pass makes one update, and moves no row of the data."""
    if h0 is None:
        d = rows.select(F.size("v")).first()[0]
        h0 = start_dictionary(k or d, d, seed)
    return fit_models(rows, F.array(F.lit(0)), h0[None], steps, tol)[0]


def transform(rows: DataFrame, h: np.ndarray, steps: int = 50, tol: float = 0.0) -> DataFrame:
    """``i, w``: coefficients under a fixed dictionary; with tol 0 it stops only if the error over all rows rises."""
    return transform_models(rows, F.array(F.lit(0)), h[None], steps, tol).select("i", "w")


class JointLearner:
    """Learns one dictionary over several modalities side by side, and reconstructs any from any others."""

    def __init__(self, names: list[str], dims: list[int], coefs: list[float], k: int):
        self.names, self.dims, self.coefs, self.k = names, dims, coefs, k
        self.h: np.ndarray | None = None

    def span(self, name: str) -> tuple[int, int]:
        at = self.names.index(name)
        return sum(self.dims[:at]), sum(self.dims[: at + 1])

    def stacked(self, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
        """``i, v`` of rows with one array column per modality: scaled by its coefficient and put side by side."""
        parts = [F.transform(n, lambda x, c=self.coefs[self.names.index(n)]: x * c) for n in names or self.names]
        return rows.select("i", F.concat(*parts).alias("v"))

    def train(self, rows: DataFrame, steps: int = 50, h0: np.ndarray | None = None, seed: int = 0) -> Model:
        model = fit(self.stacked(rows), self.k, steps, 0.0, h0, seed)
        self.h = model.h
        return model

    def dictionary(self, *names: str) -> np.ndarray:
        return np.hstack([self.h[:, slice(*self.span(n))] for n in names])

    def reconstruct_internal(self, rows: DataFrame, names: list[str], steps: int = 50) -> DataFrame:
        return transform(self.stacked(rows, names), self.dictionary(*names), steps)

    def reconstruct(self, internal: DataFrame, name: str) -> DataFrame:
        """``i, v``: coefficients times a modality's dictionary, which is broadcast; a matrix product a batch."""
        held = internal.sparkSession.sparkContext.broadcast(self.dictionary(name))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"i": b["i"], "v": list(np.stack(b["w"].to_numpy()) @ held.value)})

        return internal.select("i", "w").mapInPandas(run, "i long, v array<double>")

    def modality_to_modality(self, rows: DataFrame, source: str | list[str], target: str, steps: int = 50) -> DataFrame:
        return self.reconstruct(self.reconstruct_internal(rows, [source] if isinstance(source, str) else source, steps), target)

    def modalities_to_modalities(self, rows: DataFrame, sources: list[str], targets: list[str], steps: int = 50) -> dict[str, DataFrame]:
        """Each target reconstructed from the sources, whose coefficients are found once."""
        internal = self.reconstruct_internal(rows, sources, steps)
        return {t: self.reconstruct(internal, t) for t in targets}


class FoldLearner(JointLearner):
    """One dictionary for each fold of an experiment, all learned in the same passes: ``h`` is folds x k x d."""

    def train_folds(self, rows: DataFrame, folds: int, steps: int = 50, seed: int = 0) -> list[Model]:
        """From rows with a column ``fold``: fold f's dictionary learns from the rows of all other folds and of none."""
        others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda m: ~F.coalesce(m == F.col("fold"), F.lit(False)))
        parts = [F.transform(n, lambda x, c=c: x * c) for n, c in zip(self.names, self.coefs, strict=True)]
        stacked = rows.select("i", F.concat(*parts).alias("v"), "fold")
        start = start_dictionary(self.k, sum(self.dims), seed)
        found = fit_models(stacked, others, np.repeat(start[None], folds, 0), steps, 0.0)
        self.h = np.array([m.h for m in found])
        return found

    def dictionary(self, *names: str) -> np.ndarray:
        return np.concatenate([self.h[:, :, slice(*self.span(n))] for n in names], axis=2)

    def internal(self, rows: DataFrame, names: list[str], folds: Column, steps: int = 50) -> DataFrame:
        """``i, fold, w``: coefficients of rows under the dictionaries of their ``folds``."""
        parts = [F.transform(n, lambda x, c=self.coefs[self.names.index(n)]: x * c) for n in names]
        stacked = rows.select("i", F.concat(*parts).alias("v"), folds.alias("of"))
        return transform_models(stacked, F.col("of"), self.dictionary(*names), steps).withColumnRenamed("model", "fold")

    def reconstructed(self, internal: DataFrame, name: str) -> DataFrame:
        """``i, fold, v``: coefficients times the fold's dictionary of a modality, which are broadcast."""
        held = internal.sparkSession.sparkContext.broadcast(self.dictionary(name))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    w, h = np.stack(b["w"].to_numpy()), held.value
                    v = np.empty((len(b), h.shape[2]))
                    for fold in b["fold"].unique():
                        own = (b["fold"] == fold).to_numpy()
                        v[own] = w[own] @ h[fold]
                    yield pd.DataFrame({"i": b["i"], "fold": b["fold"], "v": list(v)})

        return internal.select("i", "fold", "w").mapInPandas(run, "i long, fold int, v array<double>")
