"""A hash table in numpy."""

from __future__ import annotations

import numpy as np


class Table:
    """Non-negative int64 keys to int32 values, asked for many keys at once; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            _, first = np.unique(slot[rest], return_index=True)
            put = rest[first]
            put = put[self.keys[slot[put]] < 0]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            rest = rest[left[rest]]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.values[slot[rest[same]]]
            rest = rest[~same & (there >= 0)]
        return out
