"""Whole texts as byte arrays: bounded chunks of Arrow batches, words and hashes of any substring."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240501).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_powers = [np.ones(1, U), np.ones(1, U)]


def trim() -> None:
    """Gives memory that a task no longer needs back to the system, since Spark keeps its Python processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``limit`` text bytes (one row at least) with the texts' offsets and UTF-8 bytes; null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        low = 0
        while low < len(text):
            high = min(len(text), max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1))
            yield batch.slice(low, high - low), at[low : high + 1] - at[low], every[at[low] : at[high]]
            low = high
    trim()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n - 1, and their inverses modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            size = 1 << max(12, (n - 1).bit_length())
            out = np.full(size, base, U)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


class Substrings:
    """64-bit polynomial hashes of any substring of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        self.sums = np.zeros(len(data) + 1, U)
        up, self.down = powers(len(data) + 1)
        np.cumsum((_FOLDED if fold else _TABLE)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


#: Bytes outside terms: all of ASCII but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(at: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, maximal runs without white space that end with their text, and words in each text."""
    solid = _through(data, ~space)
    turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    turn = np.concatenate([[0] if len(data) and solid[0] else [], turn, [len(data)] if len(data) and solid[-1] else []]).astype(np.int64)
    start, end = turn[::2], turn[1::2]
    cut = np.unique(at[(at > 0) & (at < len(data))])
    cut = cut[solid[cut - 1] & solid[cut]]
    if len(cut):
        start, end = (np.insert(x, np.searchsorted(x, cut), cut) for x in (start, end))
    return start, end, np.diff(np.searchsorted(start, at))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _through(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of 256 bytes or booleans."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words from ``start`` to ``end`` with A-Z lower-cased, by eight bytes at a time."""
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _through(data, _LOWER)
    eight = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    size = end - start
    h = mix(size.astype(U) + (U(seed) << U(32)))
    live = np.arange(len(start))
    for k in range(0, int(size.max(initial=0)), 8):
        if k:
            live = live[size[live] > k]
        word = eight[start[live] + k]
        over = np.maximum(0, 8 - (size[live] - k)).astype(U) << U(3)
        h[live] = mix(h[live] * U(_BASE) ^ word << over)
    return h


def shingles(at: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``size`` words with A-Z lower-cased; a text with fewer words has them all as one."""
    start, end, per = words(at, data)
    h = word_hashes(data, start, end)
    runs = np.where(per >= size, per - size + 1, (per > 0).astype(per.dtype))
    text = np.repeat(np.arange(len(per)), runs)
    low = np.repeat(np.cumsum(per) - per, runs) + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    span = np.minimum(per, size)[text]
    out = span.astype(U)
    for j in range(size):
        out = out * U(0x9FB21C651E98DF25) + np.where(span > j, h[np.minimum(low + j, max(0, len(h) - 1))], U(0)) if len(h) else out
    return text, mix(out)


def sets(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the n texts' sets and their distinct hashes, text by text in order; ``text`` ascends."""
    ends = np.searchsorted(text, np.arange(n + 1)).tolist()
    h = h.copy()
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        h[low:high].sort()
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return np.bincount(text[new], minlength=n), h[new]


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """An Arrow column of the strings from ``start`` to ``end``, with A-Z lower-cased."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    held = _through(data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], _LOWER)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)]).cast(pa.string())


def as_list(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow column of lists from their sizes and all values in a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
