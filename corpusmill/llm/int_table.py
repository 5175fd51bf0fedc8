"""Hash table from 64-bit to 64-bit integers whose look-ups and insertions are numpy array operations."""

from __future__ import annotations

import numpy as np

_EMPTY = np.int64(-1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """Keys are 0 or more; open addressing with linear probing, at most half full."""

    def __init__(self, keys=(), values=()):
        self.used = 0
        self._room(max(16, 4 * len(keys)))
        if len(keys):
            self.insert(np.asarray(keys, np.int64), np.asarray(values, np.int64))

    def _room(self, least: int) -> None:
        self.bits = int(least - 1).bit_length()
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.zeros(1 << self.bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        rest = np.flatnonzero((there != keys) & (there != _EMPTY))
        keys, slot = keys[rest], slot[rest]
        while len(rest):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == keys
            out[rest[hit]] = self.values[slot[hit]]
            on = ~hit & (there != _EMPTY)
            rest, keys, slot = rest[on], keys[on], slot[on]
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't in the table yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held = self.keys != _EMPTY
            keys, values = np.append(self.keys[held], keys), np.append(self.values[held], values)
            self.used = 0
            self._room(4 * len(keys))
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.values[taken] = keys[free[first]], values[free[first]]
            left = np.ones(len(keys), bool)
            left[free[first]] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)
