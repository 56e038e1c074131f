"""Hashed n-gram histograms of whole texts and the small linear algebra that the classifiers share."""

from __future__ import annotations

import numpy as np

from .common import LOWER, buffers, mix, steps

#: Classes of bytes for the shape of a text: small, capital, digit, beyond ASCII, space, line end,
#: control; every punctuation mark is a class of its own.
_shape = np.zeros(256, np.uint32)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
_shape[128:] = 1
_shape[48:58], _shape[65:91], _shape[97:123] = 2, 3, 4
_shape[[9, 32]], _shape[[10, 13]] = 5, 6
for _i, _b in enumerate(_marks):
    _shape[_b] = 7 + _i
_letters = np.where(np.arange(256) < 128, np.array([LOWER[b] if 97 <= LOWER[b] <= 122 else 32 for b in range(256)]), np.arange(256)).astype(np.uint32)
#: Dimensions kept for the length of the text, by powers of two.
LENGTHS = 24


def histograms(array, kind: str, dims: int):
    """(i, j, counts) for runs of rows; counts has a row for each text and ``dims`` columns.

    kind "shape" counts 3-grams of byte classes and the length; "letters" counts 1- to 3-grams of
    lower-cased letters, all else being one blank. An empty text has zeros (shape: only its length).
    """
    offsets, data = buffers(array)
    table = _shape if kind == "shape" else _letters
    room = dims - LENGTHS if kind == "shape" else dims
    for i, j in steps(offsets, rows=512):
        at = offsets[i:j + 1] - offsets[i]
        codes = table[data[offsets[i]:offsets[j]]]
        rows = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(at))
        counts = np.zeros((j - i) * dims, np.int64)
        for n in (3,) if kind == "shape" else (1, 2, 3):
            m = len(codes) - n + 1
            if m <= 0:
                continue
            gram = codes[:m].astype(np.uint64)
            for k in range(1, n):
                gram = gram << np.uint64(8) | codes[k:m + k]
            column = mix(gram + np.uint64(n << 32)) % np.uint64(room)
            good = rows[:m] == rows[n - 1:]
            if kind == "letters":
                good &= (codes[:m] != 32) | (codes[n - 1:] != 32)
            counts += np.bincount(rows[:m][good] * dims + column[good].astype(np.int64), minlength=len(counts))
        counts = counts.reshape(j - i, dims)
        if kind == "shape":
            size = np.minimum(np.ceil(np.log2(np.diff(at) + 1)).astype(np.int64), LENGTHS - 1)
            counts[np.arange(j - i), room + size] = 1
        yield i, j, counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped counts times idf, of length 1 (zero rows stay zero)."""
    return unit(np.log1p(counts).astype(np.float32) * idf)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def idf_of(damped: np.ndarray) -> np.ndarray:
    n = len(damped)
    return (np.log((1 + n) / (1 + (damped > 0).sum(0))) + 1).astype(np.float32)


def latent_basis(x: np.ndarray, rank: int, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors (dims x rank) by subspace iteration."""
    rank = max(1, min(rank, *x.shape))
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, min(x.shape)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def centroids(x: np.ndarray, k: int, seed: int = 0, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; centres start far apart. At most one centre for each distinct row."""
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(1)
        if far.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, x[[int(far.argmin())]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres.astype(np.float32)
