"""Minimal perfect hashing of sets of 64-bit keys, with numpy.

Level by level every key left goes to one place of a bit array by the level's hash; keys
alone at their place set its bit and are done, the others go on.  A key's index is the
number of set bits before its own, so n keys get the indexes 0 .. n - 1.  A key that is not
in the set may get any index, so whoever looks keys up compares them with the stored ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places of a level for each key left.
PLACES = 1.6


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys, another for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """levels: places of each level; before: set bits before every place of all levels, one after another."""

    levels: np.ndarray
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of a set of different keys."""
        left, levels, bits = np.asarray(keys, np.uint64), [], []
        while len(left):
            size = max(4, int(PLACES * len(left)))
            place = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(size)
            bits.append(alone)
            left = left[~alone[place]]
        return cls.of(np.array(levels, np.int64), np.concatenate([np.zeros(0, bool), *bits]))

    @classmethod
    def of(cls, levels: np.ndarray, bits: np.ndarray) -> PerfectHash:
        return cls(levels, bits, np.cumsum(bits, dtype=np.int64) - bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key; -1 for a key that no level places."""
        keys = np.asarray(keys, np.uint64)
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for number, size in enumerate(self.levels.tolist()):
            place = start + (mixed(keys[left], number) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place]
            out[left[hit]] = self.before[place[hit]]
            left, start = left[~hit], start + size
            if not len(left):
                break
        return out
