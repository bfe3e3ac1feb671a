"""Minimum-cost bipartite assignment of small matrices, one per group."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_weight_assignment(w: np.ndarray) -> list[int | None]:
    """The column of each row at the least total weight: shortest augmenting paths with potentials.

    With more rows than columns, rows that get no column have None.
    """
    w = np.asarray(w, float)
    n, m = w.shape
    if n > m:
        out: list[int | None] = [None] * n
        for j, i in enumerate(min_weight_assignment(w.T)):
            out[i] = j
        return out
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for i in range(n):
        owner[m], j = i, m
        least, via, used = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            used[j] = True
            row = owner[j]
            free = ~used[:m]
            slack = w[row] - u[row] - v[:m]
            closer = free & (slack < least)
            least[closer], via[closer] = slack[closer], j
            nxt = int(np.where(free, least, np.inf).argmin())
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j = nxt
        while j != m:
            owner[j], j = owner[via[j]], via[j]
    out = [None] * n
    for j in range(m):
        if owner[j] >= 0:
            out[owner[j]] = j
    return out


def brute_force(w: np.ndarray) -> float:
    """The least total weight of a square matrix over all permutations."""
    return min(sum(w[i, p] for i, p in enumerate(q)) for q in permutations(range(len(w))))


def assigned(cells: DataFrame, by: str) -> DataFrame:
    """``by, i, j, w`` chosen for each group of ``by, i, j, w``; a group is one small matrix, with a task to itself."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        w = g.pivot(index="i", columns="j", values="w")
        got = [(r, c) for r, c in enumerate(min_weight_assignment(w.to_numpy())) if c is not None]
        return pd.DataFrame({by: g[by].iloc[0], "i": [w.index[r] for r, _ in got], "j": [w.columns[c] for _, c in got], "w": [w.to_numpy()[r, c] for r, c in got]})

    kind = cells.schema[by].dataType.simpleString()
    return cells.groupBy(by).applyInPandas(run, f"{by} {kind}, i long, j long, w double")


def inverse(perm: DataFrame, n: DataFrame) -> DataFrame:
    """``i, j`` with the columns swapped, null for each of ``n(i)`` that nothing maps to."""
    return n.join(perm.select(F.col("j").alias("i"), F.col("i").alias("j")), "i", "left")


def weight(cells: DataFrame, perm: DataFrame) -> DataFrame:
    return cells.join(perm, ["i", "j"]).agg(F.sum("w").alias("weight"))
