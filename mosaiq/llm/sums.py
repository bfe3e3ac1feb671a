"""Arrays of counts that tasks make, cut into parts and summed as a tree."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import trim

#: Numbers of an array that are summed together; arrays that a first sum takes.
PART, FAN = 1 << 16, 64


def packed(counts: np.ndarray) -> bytes:
    """Counts in the least type that holds them, as pairs of place and count where most are zero."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    some = np.flatnonzero(counts)
    out = io.BytesIO()
    if len(some) * (4 + kind.itemsize) < len(counts) * kind.itemsize:
        np.savez(out, n=len(counts), at=some.astype(np.uint32), x=counts[some].astype(kind))
    else:
        np.savez(out, x=counts.astype(kind))
    return zlib.compress(out.getvalue(), 1)


def unpacked(data: bytes) -> np.ndarray:
    with np.load(io.BytesIO(zlib.decompress(data))) as held:
        if "at" not in held:
            return held["x"].astype(np.int64)
        out = np.zeros(int(held["n"]), np.int64)
        out[held["at"]] = held["x"]
        return out


def parts_of(arrays: dict[int, np.ndarray], size: int = PART) -> Iterator[pa.RecordBatch]:
    """Rows of the parts of ``size`` numbers, without those of zeros, of a task's arrays."""
    task = TaskContext.get().partitionId()
    for k, counts in arrays.items():
        for low in range(0, len(counts), size):
            part = counts[low : low + size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([low // size], pa.int32()), pa.array([task], pa.int32()), pa.array([packed(part)], pa.binary())], names=["k", "part", "task", "counts"])
    trim()


PARTS = "k int, part int, task int, counts binary"


def tree_sum(parts: DataFrame, most: int | None = None) -> DataFrame:
    """``k, part, task, counts``: the sum of each part over all tasks, first over ``FAN`` tasks at a time; sums stop at ``most``."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in at] + [pa.array([packed(total)], pa.binary())], names=["k", "part", "task", "counts"])

        for batch in batches:
            for k, part, task, data in zip(*(batch.column(c) for c in range(4)), strict=True):
                key, counts = (k.as_py(), part.as_py(), task.as_py()), unpacked(data.as_py())
                if key != at:
                    if at:
                        yield row()
                    at, total = key, counts
                else:
                    total = total + counts
                if most:
                    total = np.minimum(total, most)
        if at:
            yield row()

    for step in (FAN, 1 << 31):
        parts = parts.withColumn("task", F.floor(F.col("task") / step).cast("int")).repartition("k", "part", "task").sortWithinPartitions("k", "part", "task").mapInArrow(summed, PARTS)
    return parts
