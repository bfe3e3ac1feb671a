"""Which labelled documents a classifier learns from, and where."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text leaves 1 modulo 3. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``text, label`` of at most ``most`` labelled documents that aren't held out, the same ones on every run.

    Only the labels are sampled, by a hash of the id; the sample, which ``most`` bounds, is broadcast to
    the documents. Null labels, and labels other than 0 and 1, aren't used.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def learned(rows: DataFrame, fit: Callable[[list[int], list[bytes]], Any]) -> Any:
    """What ``fit`` makes of the labels and features of all ``rows(label, features)``, sorted by both.

    The rows, which ``sample`` bounds, meet in one task; only what was learned comes to the driver, whose
    memory the features and what learning needs besides would take for as long as it runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(pair for batch in batches for pair in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([x for x, _ in pairs], [x for _, x in pairs]))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])
