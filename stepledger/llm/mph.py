"""A minimal perfect hash over 128-bit keys, as arrays.

Level by level, keys are hashed into a bit array somewhat larger than their number; those that are alone at their bit stay
there, the others go to the next level. A key's slot is the number of set bits before its own. All operations are on
whole arrays of keys.
"""

from __future__ import annotations

import numpy as np

_ROOM = 2  # bits per key and level


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (a public finalizer of shifts and multiplications)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for ``n`` distinct keys ``(first, second)``."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.size = len(first)
        self._levels: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0
        while len(first):
            size = _ROOM * len(first) + 1
            place = self._place(first, second, len(self._levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self._levels.append((alone, base + np.cumsum(alone) - alone))
            base += int(alone.sum())
            rest = ~alone[place]
            first, second = first[rest], second[rest]

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
            return (mixed(mixed(first + salt) ^ second) % np.uint64(size)).astype(np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that is not in the set gets any slot, or -1."""
        out = np.full(len(first), -1, np.int64)
        todo = np.arange(len(first))
        for level, (alone, rank) in enumerate(self._levels):
            place = self._place(first[todo], second[todo], level, len(alone))
            here = alone[place]
            out[todo[here]] = rank[place[here]]
            todo = todo[~here]
        return out
