"""Sets of hashed word shingles from raw UTF-8, a slice of rows at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the odd base modulo 2**64, and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            step = U(pow(int(BASE), len(self.up), 1 << 64))
            back = U(pow(int(BASE), -len(self.up), 1 << 64))
            self.up = np.concatenate([self.up, self.up * step])
            self.down = np.concatenate([self.down, self.down * back])
        return self.up, self.down


powers = Powers()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, and the place of each row's first word."""
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)  # places where a row starts
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    up, down = powers.get(n + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:n])])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    return hashes, np.searchsorted(starts, offsets)


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; the whole sequence where a row has fewer words."""
    hashes, bounds = words(data, offsets)
    chained = hashes[: max(len(hashes) - width + 1, 0)].copy()
    for i in range(1, width):
        chained = mix(chained * BASE + hashes[i : i + len(chained)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(chained[a : b - width + 1]))
        elif b > a:
            whole = hashes[a : a + 1]
            for i in range(a + 1, b):
                whole = mix(whole * BASE + hashes[i : i + 1])
            out.append(mix(whole + U(b - a)))  # unlike any shingle of full width
        else:
            out.append(np.zeros(0, U))
    return out
