"""Vectorised fingerprints of fixed-length windows over sequences of units (words or bytes).

Every window of ``length`` units is owned by its winnowed anchor: the leftmost
of the smallest ``gram``-unit hashes inside it. Equal windows therefore own equal
anchors at equal offsets. Consecutive windows with the same anchor form a
*run*; the hash of the run's hull (all units that its windows cover) tells
whether two runs are equal as a whole.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Bits of a packed value that hold a position; the rest are the hash's top bits.
_POS_BITS = 24
CHUNK_UNITS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (64 bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = max(n, CHUNK_UNITS + 1024)
        for key, base in (("p", _BASE), ("q", _INV)):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["p"][:n], _POWERS["q"][:n]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Prefix:
    """Prefix sums of a unit sequence; hashes of any stretches of it."""

    def __init__(self, values: np.ndarray):
        p, self.inv = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[:-1], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Hash of each stretch of that length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inv[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


#: True for the bytes 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are no separators;
    document d owns ``data[bounds[d]:bounds[d + 1]]`` and no word leaves it."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return Prefix(byte_values(data)).stretch(starts, ends)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (two block-wise scans)."""
    n = len(x)
    if width == 1:
        return x
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` consecutive hashes; stretches whose places fit _POS_BITS, one after the other."""
    place = np.uint64((1 << _POS_BITS) - 1)
    most = max(1, min(1 << _POS_BITS, max(CHUNK_UNITS, 2 * width)) - width + 1)
    if width > 1 << _POS_BITS:
        raise ValueError("a window has more units than a position can hold")
    out = []
    for lo in range(0, len(grams) - width + 1, most):
        part = grams[lo : lo + most + width - 1]
        packed = (part & ~place) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(packed, width) & place).astype(np.int64) + lo)
    return np.concatenate(out)


def runs(values: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of all documents in ``values``; document d owns
    ``values[bounds[d]:bounds[d + 1]]``.

    Returns (document, start of the first window in its document, windows,
    anchor hash, hull hash), one entry for each run.
    """
    none = np.zeros(0, np.int64)
    n = len(values)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = Prefix(values)
    grams = prefix.every(gram)
    anchor = _anchors(grams, length - gram + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= bounds[doc + 1]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    at = anchor[first]
    offset = mix((at - first).astype(np.uint64) * np.uint64(512) + (stop - first).astype(np.uint64) + np.uint64(1))
    hull = mix(prefix.stretch(first, stop - 1 + length) ^ offset)
    return doc[first], first - bounds[doc[first]], stop - first, grams[at], hull
