"""Term counts of documents for latent-semantic vectors.

Terms: trigrams over classes of bytes (what the text looks like), hashed words
(what it says), and bands of four repetition and length measures. Every count
covers the whole text. A row is the square root of each term's share in its group.
"""

from __future__ import annotations

import numpy as np

from lamella.llm import windows as W

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,;:", "!?", "|", "'\"()-")
_OTHER, _HIGH, N_CLASSES = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2
CLASS = np.full(256, _OTHER, np.int64)
for _i, _c in enumerate(_CLASSES):
    CLASS[[ord(x) for x in _c]] = _i
CLASS[128:] = _HIGH
SHAPES, WORDS, BANDS = N_CLASSES**3, 512, 12
N_TERMS = SHAPES + WORDS + 5 * BANDS


def _share(doc: np.ndarray, term: np.ndarray, n: int, terms: int) -> np.ndarray:
    out = np.bincount(doc * terms + term, minlength=n * terms).reshape(n, terms).astype(np.float32)
    out /= np.maximum(out.sum(1, keepdims=True), 1)
    return np.sqrt(out)


def _bands(x: np.ndarray) -> np.ndarray:
    """A value from 0 to 1 spread over the two nearest of BANDS places."""
    at = np.clip(x, 0, 1) * (BANDS - 1)
    low = np.minimum(at.astype(int), BANDS - 2)
    out = np.zeros((len(x), BANDS), np.float32)
    rows = np.arange(len(x))
    out[rows, low] = np.sqrt(low + 1 - at)
    out[rows, low + 1] = np.sqrt(at - low)
    return out


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_TERMS for each text; an empty text has only its bands."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kind = CLASS[data]
    shape, inside = np.zeros(0, np.int64), np.zeros(0, bool)
    if len(data) > 2:
        shape = (kind[:-2] * N_CLASSES + kind[1:-1]) * N_CLASSES + kind[2:]
        inside = doc[:-2] == doc[2:]
    shapes = _share(doc[: len(shape)][inside], shape[inside], n, SHAPES)
    starts, ends = W.word_bounds(data, offsets)
    values = W.word_values(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    many = np.diff(bounds)
    of = np.repeat(np.arange(n), many)
    hashed = _share(of, (values % np.uint64(WORDS)).astype(np.int64), n, WORDS)
    total = np.maximum(many, 1)
    # Number of different words of each document; documents are told apart by their top bits.
    marked = np.sort((values >> np.uint64(20)) | (of.astype(np.uint64) << np.uint64(44)))
    fresh = np.append(True, marked[1:] != marked[:-1])[: len(marked)]
    different = np.bincount((marked[fresh] >> np.uint64(44)).astype(np.int64), minlength=n) / total
    again = np.zeros(n)
    if len(values) > 1:
        same = (values[1:] == values[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n) / total
    size = np.diff(offsets)
    letters = np.bincount(doc[(kind == 0) | (kind == _HIGH)], minlength=n) / np.maximum(size, 1)
    lines = (np.bincount(doc[data == 10], minlength=n) + 1) / (total + 1)
    bands = np.concatenate([_bands(x) for x in (different, again, letters, lines, np.log2(total) / 16)], 1)
    return np.concatenate([shapes, 0.5 * hashed, 0.5 * bands], 1)
