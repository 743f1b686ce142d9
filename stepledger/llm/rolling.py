"""Hashes of all words and word windows, or of all byte windows, of a text by array operations.

A text's prefix sums of ``value[k] * base**k`` (modulo 2**64) give the polynomial hash of any piece as a difference of two
of them, times a power of the base's inverse. Results go through a bijective mixing.

Such a hash is weak on long pieces over two values: the Thue-Morse word of 1,024 letters and its complement meet under every
base. So it serves for windows of words and pieces of bytes below that length only. Words have any length and are compared
by ``word_values``: two independent hashes, eight bytes at a time through the mixing, and XXH3 for long words.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from stepledger.llm.mph import mixed

#: Bytes or words that one round of array operations takes, to bound its memory.
SLICE = 1 << 20
_MASK = (1 << 64) - 1
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], filled = 1, 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out


class Rolling:
    """Powers of one base, and of its inverse, for pieces of up to SLICE values and some overlap."""

    def __init__(self, which: int = 0, longest: int = 1 << 12) -> None:
        base = _BASES[which]
        self.longest = longest
        self.up = _powers(base, SLICE + longest + 1)
        self.down = _powers(pow(base, -1, 1 << 64), SLICE + longest + 1)

    def pieces(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``values[a:b]`` for each pair; ``values`` has at most SLICE + longest entries."""
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def windows(self, values: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        """Hash of the window of ``width`` values at each of the ascending places ``at``."""
        out = np.empty(len(at), np.uint64)
        for a in range(0, len(values), SLICE):
            here = slice(*np.searchsorted(at, (a, a + SLICE)))
            if here.start < here.stop:
                own = at[here] - a
                out[here] = self.pieces(values[a : a + SLICE + width - 1], own, own + width)
        return out


@functools.lru_cache(maxsize=1)
def tables() -> tuple[Rolling, Rolling]:
    """Tables of powers of two bases, made once per Python worker."""
    return Rolling(0), Rolling(1)


def byte_values(text: np.ndarray) -> np.ndarray:
    return _VALUES[text]


def words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than the six ASCII white-space characters."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACES[text]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


#: Words of more bytes are hashed by XXH3.
LONG_WORD = 32
_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _lanes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one number, zeros beyond ``sizes``; ``text`` goes on for seven bytes more."""
    every = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    keep = np.minimum(sizes, 8).astype(np.uint64)
    return every[starts] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * keep))


def word_values(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, none of which is empty."""
    text, sizes = np.concatenate([text, np.zeros(8, np.uint8)]), ends - starts
    out = [np.empty(len(starts), np.uint64) for _ in _SEEDS]
    for a in range(0, len(starts), SLICE):
        part = slice(a, a + SLICE)
        size = sizes[part]
        values = [size.astype(np.uint64) * np.uint64(seed) for seed in _SEEDS]
        for done in range(0, LONG_WORD, 8):
            more = np.flatnonzero(size > done) if done else slice(None)
            lanes = _lanes(text, starts[part][more] + done, size[more] - done)
            for value, seed in zip(values, _SEEDS, strict=True):
                value[more] = mixed((value[more] ^ lanes) + np.uint64(seed))
        for value, found in zip(values, out, strict=True):
            found[part] = value
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = xxhash.xxh3_128_intdigest(text[starts[k] : ends[k]].data)
        out[0][k], out[1][k] = digest & _MASK, digest >> 64
    return out[0], out[1]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, rolling: Rolling) -> np.ndarray:
    """A hash per word; texts and words of any length."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        origin = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, origin + SLICE, "right")))
        if ends[b - 1] - origin > SLICE:  # one word longer than a slice: hash of the hashes of its parts
            inner = byte_values(text[origin : ends[a]])
            cuts = np.append(np.arange(0, len(inner), SLICE), len(inner))
            parts = [rolling.pieces(inner[x:y], np.array([0]), np.array([y - x]))[0] for x, y in zip(cuts, cuts[1:], strict=False)]
            out[a] = rolling.pieces(np.array(parts, np.uint64)[-SLICE:], np.array([0]), np.array([min(len(parts), SLICE)]))[0]
        else:
            values = byte_values(text[origin : ends[b - 1]])
            out[a:b] = rolling.pieces(values, starts[a:b] - origin, ends[a:b] - origin)
        a = b
    return out
