"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, keep

#: Links that a task joins at once, about.
LINKS = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), sorted, and the smallest node that links reach from each."""
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = of[: len(a)], of[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, label[end], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges(a, b)``: the smallest node that links reach.

    Tasks of about ``LINKS`` links each first join theirs to stars around the smallest nodes; what one task
    joins is done then. The stars of several tasks are joined in rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in smallest(*map(np.concatenate, zip(*held, strict=True)))], names=["node", "label"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(2)])
            size += batch.num_rows
            if size > LINKS:
                yield joined()
                held, size = [], 0
        if held:
            yield joined()

    links = keep(edges.select("a", "b"), "links")
    tasks = -(-links.count() // LINKS)
    stars = keep(links.coalesce(max(1, tasks)).mapInArrow(run, "node long, label long"), "stars")
    discard(links)
    if tasks < 2:
        return stars
    labels = _in_rounds(stars.select(F.col("node").alias("a"), F.col("label").alias("b")))
    discard(stars)
    return labels


def _in_rounds(edges: DataFrame) -> DataFrame:
    """``components`` by rounds of joins.

    Each round takes the smallest label around a node and then the label of that label, so that the
    rounds grow with the logarithm of a component's diameter. Every round is written, which cuts its
    lineage. Self-links and repeated links are harmless; an empty table gives no rows.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = keep(labels, "labels")
    before = labels
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = keep(near.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        discard(before)
        before, labels = after, after.select("node", "label")
        if after.filter("label < old").isEmpty():
            discard(both)
            return labels
