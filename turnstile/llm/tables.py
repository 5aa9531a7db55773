"""Open-addressing table in numpy from pairs of numbers to places in arrays of values."""

from __future__ import annotations

import numpy as np


class PairTable:
    """Keys (left, right) of non-negative 32-bit numbers; ``find`` gives each
    pair's slot, and a slot that holds no key has the default values."""

    def __init__(self, left: np.ndarray, right: np.ndarray, **values: tuple[np.ndarray, int]) -> None:
        bits = int(np.ceil(np.log2(8 * len(left) + 16)))
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.key = np.full(self.mask + 1, -1, np.int64)
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            first = np.unique(at, return_index=True)[1]
            won = todo[first[self.key[at[first]] == -1]]
            self.key[slot[won]] = keys[won]
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & self.mask
        for name, (given, default) in values.items():
            column = np.full(self.mask + 1, default, np.int32)
            column[slot] = given
            setattr(self, name, column)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        # the top bits of the product depend on both numbers
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        held = self.key[slot]
        todo = np.nonzero((held != keys) & (held != -1))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.key[slot[todo]]
            todo = todo[(held != keys[todo]) & (held != -1)]
        return slot
