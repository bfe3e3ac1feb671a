"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, learned, sample
from .textbytes import PUNCTUATION, Substrings, chunks, words

#: Documents that are learned from at most; hash buckets; rows that a term needs; factors of a term.
SAMPLE, BUCKETS, SUPPORT, FACTORS = 12_000, 1 << 22, 4, 8
#: What a weight, and a term's factors, must gain to stay, and the epochs until it is the whole of that; the share of it once the terms that stay are known; what missing a row of class 1 costs.
WEIGHT_COST, FACTOR_COST, RAMP, STAYED, MISSED = 1e-3, 4e-3, 4, 0.3, 4.0
#: Rows below which chance counts for more.
FEW = 4500
#: First bytes of a longer term that are a term of their own.
STEM = 5


def terms(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and buckets of each text's distinct terms: its words without case and punctuation, and their stems."""
    start, end, per = words(at, data, PUNCTUATION)
    text = np.repeat(np.arange(len(per)), per)
    sub = Substrings(data, fold=True)
    long_ = end - start > STEM
    full = sub.of(start, end)
    stems = ~sub.of(start[long_], start[long_] + STEM)
    bucket = (np.concatenate([full, stems]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    both = np.unique(np.concatenate([text, text[long_]]) * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum of the products of factor vectors over pairs of present terms)."""

    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def logits(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        if not len(self.buckets):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        hit = self.buckets[at] == bucket
        return self._raw(text[hit], at[hit], n)[0]

    def _raw(self, text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        # One factor at a time: the pairs are many, and they are in a task's memory while a machine is learned.
        sums = np.empty((n, self.factors.shape[1]))
        for f in range(sums.shape[1]):
            sums[:, f] = np.bincount(text, weights=self.factors[:, f][term], minlength=n)
        squares = np.bincount(text, weights=(self.factors**2).sum(1)[term], minlength=n)
        return self.bias + np.bincount(text, weights=self.weight[term], minlength=n) + ((sums**2).sum(1) - squares) / 2, sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(text: np.ndarray, bucket: np.ndarray, label: np.ndarray, **settings) -> Machine:
    """``fit_lists`` for (document, bucket) pairs, each of them once."""
    order = np.argsort(text, kind="stable")
    return fit_lists(np.split(bucket[order], np.searchsorted(text[order], np.arange(1, len(label)))), label, **settings)


@dataclass
class _Edges:
    """Pairs of documents and terms, document by document."""

    term: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray], number: np.ndarray) -> _Edges:
        used = [x[x >= 0] for x in (number[terms_] for terms_ in lists)]
        return cls(np.concatenate(used), np.concatenate([[0], np.cumsum([len(x) for x in used])]))

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``rows`` and terms of some documents."""
        size = self.at[rows + 1] - self.at[rows]
        place = np.repeat(np.arange(len(rows)), size)
        return place, self.term[np.repeat(self.at[rows] - (np.cumsum(size) - size), size) + np.arange(len(place))]


def _descend(m: Machine, edges: _Edges, label: np.ndarray, cost: np.ndarray, epochs: int, ramp: int, weight_cost: float, factor_cost: float, rate: float, batch: int, rng: np.random.Generator) -> None:
    """Steps against the gradient of the costly log loss, each followed by taking from a weight, and from the length of a term's factors, what they must gain.

    A step is as long as the earlier gradients of its term are small, so that rare terms learn as fast as common
    ones. In the first ``ramp`` epochs less is taken, so that pairs are found before their terms could be given up.
    """
    past, seen, seen_factors = 1e-6, np.full(len(m.weight), 1e-6), np.full(len(m.weight), 1e-6)
    for epoch in range(epochs):
        taken = factor_cost * min(1.0, (epoch + 1) / ramp)
        order = rng.permutation(len(label))
        for low in range(0, len(label), batch):
            rows = order[low : low + batch]
            text, term = edges.rows(rows)
            own, term = np.unique(term, return_inverse=True)
            part = Machine(own, m.bias, m.weight[own], m.factors[own])
            logit, sums = part._raw(text, term, len(rows))
            g = cost[rows] * (_sigmoid(logit) - label[rows]) / len(rows)
            each = g[text]
            slope = np.bincount(term, weights=each, minlength=len(own))
            slopes = np.empty_like(part.factors)
            for f in range(slopes.shape[1]):
                slopes[:, f] = np.bincount(term, weights=each * (sums[:, f][text] - part.factors[:, f][term]), minlength=len(own))
            past += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(past)
            seen[own] += slope**2
            step = rate / np.sqrt(seen[own])
            moved = part.weight - step * slope
            m.weight[own] = np.sign(moved) * np.maximum(np.abs(moved) - step * weight_cost, 0)
            seen_factors[own] += (slopes**2).mean(1)
            step = (rate / 2 / np.sqrt(seen_factors[own]))[:, None]
            moved = part.factors - step * slopes
            length = np.linalg.norm(moved, axis=1, keepdims=True)
            m.factors[own] = moved * np.maximum(1 - step * taken / np.maximum(length, 1e-12), 0)
    m.bias = float(m.bias)


def fit_lists(lists: list[np.ndarray], label: np.ndarray, epochs: tuple[int, int] = (24, 8), rate: float = 0.1, seed: int = 3) -> Machine:
    """Learns a machine from each document's distinct buckets.

    Every term of ``SUPPORT`` rows or more takes part, with a weight and factors. While it learns, a weight
    goes to zero unless it gains ``WEIGHT_COST``, and all factors of a term together unless they gain
    ``FACTOR_COST``, so that what stays are the terms that tell the classes apart, by themselves or in pairs with others,
    however equal they are alone and however rare a single pair is. A second descent over these terms, at
    ``STAYED`` of the costs, undoes what the first one took from them. The fewer rows there are, the more chance
    there is in a slope: costs grow as the root of 1 / n below ``FEW`` rows, and with them the passes. Missing a row of class 1 costs ``MISSED`` times
    what a wrong one of class 0 costs, and both classes weigh the same. Without rows of both classes the score is
    the share of class 1, or 0.5 without rows; so it is for a text with no term that stayed, but for the bias that was learned.
    """
    n, ones = len(label), int(label.sum())
    if not ones or ones == n:
        return Machine(np.zeros(0, np.int64), float(np.log((ones + 0.5) / (n - ones + 0.5))), np.zeros(0), np.zeros((0, FACTORS)))
    counts = np.zeros(BUCKETS, np.int32)
    for terms_ in lists:
        counts[terms_] += 1
    known = np.flatnonzero(counts >= SUPPORT)
    number = np.full(BUCKETS, -1, np.int32)
    number[known] = np.arange(len(known))
    rng = np.random.default_rng(seed)
    short = max(1.0, FEW / n)
    taken, batch = short**0.5, min(256, max(16, n // 16))
    first, second = (int(x * max(1.0, short / 4)) for x in epochs)
    cost = np.where(label == 1, n / ones * MISSED, n / (n - ones)) / (1 + MISSED)
    m = Machine(known, float(np.log(ones / (n - ones))), np.zeros(len(known)), rng.normal(0, 0.05, (len(known), FACTORS)))
    _descend(m, _Edges.of(lists, number), label, cost, first, RAMP, taken * WEIGHT_COST, taken * FACTOR_COST, rate, batch, rng)
    stay = np.flatnonzero((m.weight != 0) | m.factors.any(1))
    m = Machine(known[stay], m.bias, m.weight[stay], m.factors[stay])
    number[:] = -1
    number[m.buckets] = np.arange(len(stay))
    _descend(m, _Edges.of(lists, number), label, cost, second, 1, STAYED * taken * WEIGHT_COST, STAYED * taken * FACTOR_COST, rate, batch, rng)
    stay = np.flatnonzero((m.weight != 0) | m.factors.any(1))
    return Machine(m.buckets[stay], m.bias, m.weight[stay], m.factors[stay])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Machine:
    """The machine for ``labels(doc_id, label)``, from at most ``most`` documents whose terms meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches):
            text, bucket = terms(at, data)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            blobs = [bucket[i:j].astype(np.int32).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(blobs, pa.binary())], names=["label", "terms"])

    def fitted(marks: list[int], blobs: list[bytes]) -> Machine:
        return fit_lists([np.frombuffer(b, np.int32) for b in blobs], np.array(marks, np.float64))

    return learned(sample(docs, labels, label, most).mapInArrow(run, "label int, terms binary"), fitted)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text)``; a null text is empty. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches):
            score = _sigmoid(held.value.logits(*terms(at, data), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCORED)


def only_clean(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches):
            yield batch.filter(pa.array(_sigmoid(held.value.logits(*terms(at, data), batch.num_rows)) < threshold))

    return docs.mapInArrow(run, docs.schema)
