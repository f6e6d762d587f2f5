"""Rolling hashes, window minima and super-windows of byte strings in numpy.

A window is ``length`` bytes; its minimizer is the ``gram``-byte string inside
it with the smallest hash (the leftmost on ties), so equal windows have equal
minimizers at equal places. A super-window is a maximal run of consecutive
windows of one document whose minimizer is the same place: every window lies in
exactly one, and equal windows always meet under the same minimizer hash.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=U) | U(1)


TABLES = (_table(11), _table(12))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the good high bits of a polynomial hash over the whole word."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(32)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(x):
                out = np.full(n, x, U)
                out[0] = 1
                return np.cumprod(out, dtype=U)

            self.up, self.down = run(self.base), run(self.inverse)
        return self.up[:n], self.down[:n]


POWERS = tuple(Powers(b) for b in ODD)


class Hashed:
    """Prefix sums of a byte array from which any substring's hash follows."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = POWERS[which].to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(TABLES[which][data] * up[:len(data)], dtype=U, out=self.sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        """Hash of every substring of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (block prefix and suffix minima)."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(U).max, U)
    padded[:len(x)] = x
    block = padded.reshape(rows, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The integers of many ranges, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.repeat(start - jump, size) + np.arange(total)


PLACE = 26  # bits of a key that hold the place: one call takes up to 64 MB


def super_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, gram: int):
    """Super-windows of documents ``data[start:start + size]``: document number,
    place in ``data``, number of windows, minimizer hash, hash of the bytes."""
    if len(data) >= 1 << PLACE:
        raise ValueError("too many bytes in one call")
    docs = np.flatnonzero(size >= length)
    none = np.zeros(0, np.int64)
    if not len(docs):
        return none, none, none, none.view(U), none.view(U)
    grams = Hashed(data).fixed(gram)
    keys = (grams >> U(PLACE) << U(PLACE)) | np.arange(len(grams), dtype=U)
    least = sliding_min(keys, length - gram + 1)
    number = size[docs] - length + 1
    at = ranges(start[docs], number)
    place = (least[at] & U((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(first, len(place)))
    begin = at[first]
    doc = docs[np.searchsorted(start[docs], begin, side="right") - 1]
    return doc, begin, n, grams[place[first]], Hashed(data, 1).of(begin, begin + n - 1 + length)
