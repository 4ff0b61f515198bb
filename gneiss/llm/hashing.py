"""An open-addressing table from 64-bit keys to numbers, looked up in bulk."""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Lookup:
    """Values of distinct ``keys`` (uint64, none all ones)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY)
        self.values = np.zeros(1 << bits, dtype=values.dtype)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            spots, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[spots], self.values[spots] = keys[put], values[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, key: np.ndarray, default: float = 0) -> tuple[np.ndarray, np.ndarray]:
        """Values, ``default`` where there is none, and which keys are there."""
        out = np.full(len(key), default, dtype=self.values.dtype)
        hit = np.zeros(len(key), dtype=bool)
        at, slot = np.arange(len(key)), self._slot(key)
        while len(at):
            found = self.keys[slot]
            good = found == key[at]
            out[at[good]] = self.values[slot[good]]
            hit[at[good]] = True
            on = ~good & (found != _EMPTY)
            at, slot = at[on], (slot[on] + 1) & self.mask
        return out, hit
