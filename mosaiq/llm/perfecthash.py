"""Minimal perfect hashing of 64-bit keys, for whole arrays at once."""

from __future__ import annotations

import numpy as np

from .textbytes import mix

U = np.uint64
_LEVEL = 0xA24BAED4963EE407


class PerfectHash:
    """Maps n distinct keys to 0 .. n - 1, each to a number of its own.

    Level by level, the keys that no other key meets in a bit array of twice their number set their bit;
    the others go on to the next level. A key's number is the count of bits before its own. What isn't a
    key gets -1 or the number of a key, so whoever looks up compares with the key that is stored there.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = len(keys)
        below = 0
        while len(keys):
            n = max(64, 2 * len(keys))
            at = self._place(keys, len(self.levels), n)
            met = np.bincount(at, minlength=n)
            bits = np.zeros(-(-n // 64) * 8, np.uint8)
            packed = np.packbits(met == 1, bitorder="little")
            bits[: len(packed)] = packed
            words = bits.view("<u8").astype(U)
            count = np.bitwise_count(words).astype(np.int64)
            self.levels.append((n, words, np.cumsum(count) - count + below))
            below += int(count.sum())
            left = keys[met[at] > 1]
            if len(self.levels) > 60 and len(left) == len(keys):
                raise ValueError("keys must be distinct")
            keys = left

    @staticmethod
    def _place(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        h = mix(keys + U((level + 1) * _LEVEL & (1 << 64) - 1))
        return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where a key of the set can't be."""
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        for level, (n, words, before) in enumerate(self.levels):
            if not len(live):
                break
            at = self._place(keys[live], level, n)
            word, bit = words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit & U(1)).astype(bool)
            low = word[hit] & ((U(1) << bit[hit]) - U(1))
            out[live[hit]] = before[at[hit] >> 6] + np.bitwise_count(low)
            live = live[~hit]
        return out
