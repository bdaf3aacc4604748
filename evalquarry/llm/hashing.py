"""64-bit hashes in numpy: a seeded finaliser and hashes of any substring from running sums."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASES = (0xB7E151628AED2A6B, 0x9E3779B97F4A7C15)
#: Powers are kept for so many exponents; a longer buffer carries a factor from block to block.
BLOCK = 1 << 15


def mix(h: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser seeded by the level."""
    h = h ^ _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 modulo 2^64."""
    p = np.full(n, base & 0xFFFFFFFFFFFFFFFF, _U)
    p[:1] = 1
    return np.cumprod(p, dtype=_U)


_TABLES = [mix(np.arange(256, dtype=_U), 100 + k) for k in range(2)]
_UP = [powers(b, BLOCK) for b in _BASES]
_DOWN = [powers(pow(b, -1, 1 << 64), BLOCK) for b in _BASES]


class Substrings:
    """Hashes of substrings of a buffer of bytes, or of numbers that are hashes themselves; ``which`` chooses one of two functions."""

    def __init__(self, b: np.ndarray, which: int = 0) -> None:
        self.which, base = which, _BASES[which]
        blocks = len(b) // BLOCK + 1
        self.sums = np.zeros(len(b) + 1, _U)
        factors = powers(pow(base, BLOCK, 1 << 64), blocks)
        for k in range(blocks):
            at = k * BLOCK
            part = _TABLES[which][b[at : at + BLOCK]] if b.dtype == np.uint8 else b[at : at + BLOCK].copy()
            part *= _UP[which][: len(part)]
            part *= factors[k]
            np.cumsum(part, out=self.sums[at + 1 : at + 1 + len(part)])
            self.sums[at + 1 : at + 1 + len(part)] += self.sums[at]
        self.back = powers(pow(base, -BLOCK, 1 << 64), blocks)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= _DOWN[self.which][start & (BLOCK - 1)]
        if len(self.back) > 1:
            h *= self.back[start // BLOCK]
        return mix(h, 200 + self.which)
