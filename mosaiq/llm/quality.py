"""Document quality by attention over passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, learned, sample
from .textbytes import Substrings, chunks, words

#: Documents that are learned from at most; words of a passage; width of a passage's code and of the attention.
SAMPLE, PASSAGE, CODE, ATTENTION = 6_000, 64, 16, 12
# Kinds of bytes whose shares describe a passage, as fixed values: lower and upper case, digits, beyond ASCII, white space, end of line, and marks by use.
_KINDS = [range(97, 123), range(65, 91), range(48, 58), range(128, 256), b" \t\r\f\v", b"\n", b".", b",", b"|", b"!?", b"*#$%&@+=<>~^\\/_", b"\"'()-:;[]{}`"]
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k + 1
#: Buckets of hashed words.
LEXICAL = 32
FEATURES = len(_KINDS) + 1 + 9 + LEXICAL


def passages(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages in each text and their features; a passage has ``PASSAGE`` words, a text's last one fewer.

    Features are shares of kinds of bytes, the length of words, repeats of words next to each other and in
    the passage, words in upper case, words that end with marks, and signed shares of hashed words. White
    space before a text's first word counts in its first passage; a text without words has one passage,
    of its white space, and an empty one a passage of zeros. What a passage gets depends on its own text only.
    """
    start, end, per = words(at, data)
    count = np.maximum(1, -(-per // PASSAGE))
    first = np.cumsum(count) - count
    n = int(count.sum())
    x = np.zeros((n, FEATURES))
    text = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per)
    of = first[text] + nth // PASSAGE
    kinds = len(_KINDS) + 1
    # A byte is in the passage of the last word of its own text that starts at or before it, else in the text's first.
    lead = np.zeros(len(data), np.int64)
    lead[start] = 1
    owner = np.repeat(first, np.diff(at))
    if len(start):
        owner = np.maximum(owner, of[np.maximum(np.cumsum(lead) - 1, 0)])
    by_kind = np.bincount(owner * kinds + _KIND[data], minlength=n * kinds).reshape(n, kinds)
    total = np.maximum(1, by_kind.sum(1))
    x[:, :kinds] = by_kind / total[:, None]
    size = np.bincount(of, minlength=n)
    some = np.maximum(1, size)
    h = Substrings(data, fold=True).of(start, end)
    mean = lambda v: np.bincount(of, weights=v, minlength=n) / some
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    length = end - start
    kind_first, kind_last = _KIND[data[start]], _KIND[data[end - 1]]
    inner = _KIND[data[start + length // 2]]
    for k, v in enumerate((np.log1p(length), length == 1, again, None, (kind_first == 2) & (kind_last == 2) & (length > 1), np.isin(kind_last, (10, 11)), np.isin(kind_first, (9, 10, 11)), (kind_first == 2) & (inner == 2), None)):
        if v is not None:
            x[:, kinds + k] = mean(v)
    x[:, kinds + 3] = np.bincount(of[order][new], minlength=n) / some
    x[:, kinds + 8] = np.log1p(size) / np.log1p(PASSAGE)
    sign = (h >> np.uint64(40) & np.uint64(1)).astype(np.float64) * 2 - 1
    lexical = np.bincount(of * LEXICAL + (h >> np.uint64(50)).astype(np.int64) % LEXICAL, weights=sign, minlength=n * LEXICAL)
    x[:, kinds + 9 :] = lexical.reshape(n, LEXICAL) / some[:, None]
    return count, x


@dataclass
class Model:
    """code = tanh(Wx + b); weight = softmax over passages of u . (tanh(V code) * sigmoid(G code)); score = sigmoid(c . (weighted code) + d)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        # einsum adds up each row in the same order whatever rows are beside it, so that a score is the same in any batch.
        code = np.tanh(np.einsum("ij,jk->ik", x, p["W"]) + p["b"])
        t, s = np.tanh(np.einsum("ij,jk->ik", code, p["V"])), _sigmoid(np.einsum("ij,jk->ik", code, p["G"]))
        e = np.einsum("ij,j->i", t * s, p["u"])
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * code, first)
        return {"x": x, "bag": bag, "first": first, "code": code, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(np.einsum("ij,j->i", z, p["c"]) + p["d"])}

    def scores(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, count)["y"] if len(count) else np.zeros(0)

    def attention(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self.forward(x, count)["a"] if len(count) else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(count: np.ndarray, x: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> Model:
    """Learns encoder, gated attention and classifier together by Adam on batches of documents.

    Without rows of both classes the score is the share of class 1, or 0.5 without rows.
    """
    rng = np.random.default_rng(seed)
    shape = {"W": (FEATURES, CODE), "b": (CODE,), "V": (CODE, ATTENTION), "G": (CODE, ATTENTION), "u": (ATTENTION,), "c": (CODE,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k != "b" else np.zeros(s) for k, s in shape.items()}
    n, ones = len(label), float(label.sum())
    p["d"] = np.array(np.log((ones + 0.5) / (n - ones + 0.5)))
    scale = x.std(0) if len(x) else np.ones(FEATURES)
    m = Model(x.mean(0) if len(x) else np.zeros(FEATURES), np.where(scale > 1e-6, scale, 1.0), p)
    if not ones or ones == n:
        p["c"] = np.zeros(CODE)
        return m
    first = np.cumsum(count) - count
    weight = np.where(label == 1, 0.5 * n / ones, 0.5 * n / (n - ones)) ** 0.5
    state = {k: np.zeros((2, *np.shape(v))) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = np.sort(rng.choice(n, min(n, 1024), replace=False))
        k = count[pick]
        rows = np.repeat(first[pick], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        f = m.forward(x[rows], k)
        dy = weight[pick] * (f["y"] - label[pick]) / len(pick)
        dz = dy[:, None] * p["c"]
        da = (f["code"] * dz[f["bag"]]).sum(1)
        inner = np.add.reduceat(f["a"] * da, f["first"])
        de = f["a"] * (da - inner[f["bag"]])
        dts = de[:, None] * p["u"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dcode = f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + ds @ p["G"].T
        dpre = dcode * (1 - f["code"] ** 2)
        grads = {"W": f["x"].T @ dpre, "b": dpre.sum(0), "V": f["code"].T @ dt, "G": f["code"].T @ ds, "u": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum()}
        for name, g in grads.items():
            g, s = g + decay * p[name], state[name]
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.99 * s[1] + 0.01 * g**2
            p[name] = p[name] - rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """The model for ``labels(doc_id, label)``, from at most ``most`` documents whose passage features meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches):
            count, x = passages(at, data)
            end = np.cumsum(count)
            blobs = [x[e - c : e].astype(np.float32).tobytes() for e, c in zip(end, count, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(blobs, pa.binary())], names=["label", "x"])

    def fitted(marks: list[int], blobs: list[bytes]) -> Model:
        each = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in blobs]
        x = np.concatenate(each).astype(np.float64) if each else np.zeros((0, FEATURES))
        return fit(np.array([len(e) for e in each], np.int64), x, np.array(marks, np.float64))

    return learned(sample(docs, labels, label, most).mapInArrow(run, "label int, x binary"), fitted)


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_passages int"


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages`` of each row of ``docs(doc_id, text)``; a null text is empty. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches):
            count, x = passages(at, data)
            score = held.value.scores(x, count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count.astype(np.int32))], names=[f.split()[0] for f in SCORED.split(", ")])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCORED)


def only_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches):
            count, x = passages(at, data)
            yield batch.filter(pa.array(held.value.scores(x, count) >= threshold))

    return docs.mapInArrow(run, docs.schema)
