"""An FM-index over a shard's symbols: suffix array, wavelet matrix with ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling. Symbol 0 ends a run: every 0 differs from the others
    (by position), so that no comparison passes it."""
    n = len(symbols)
    zeros = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    rank = _names(rank[order], order)
    step = 1
    while n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = _names(key[order], order)
        step *= 2
    return order


def _names(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]])) if len(order) else 0
    return out


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix: ranks of, and access to, symbols in a step for each bit."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = []
        for level in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (values >> level) & 1
            self.levels.append((level, Bits(bits), int(len(bits) - bits.sum())))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position i."""
        start, stop = np.zeros_like(i), i
        for level, bits, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            a, b = bits.rank(start), bits.rank(stop)
            start, stop = np.where(one, zeros + a, start - a), np.where(one, zeros + b, stop - b)
        return stop - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before there."""
        value, start, at = np.zeros_like(i), np.zeros_like(i), i
        for level, bits, zeros in self.levels:
            one = bits.get(at)
            a, b = bits.rank(start), bits.rank(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
            value |= one.astype(value.dtype) << level
        return value, at - start


class FMIndex:
    """Backward search and locating over symbols 1 .. size - 1; symbol 0 separates runs.

    Positions that are multiples of ``every`` and those that start a run are stored, so walking back
    from an occurrence ends before a separator.
    """

    def __init__(self, symbols: np.ndarray, size: int, every: int = 8):
        symbols = np.concatenate([np.asarray(symbols, np.int64), [0]])
        order = suffix_order(symbols)
        self.last = symbols[order - 1]  # of the first row, the closing separator
        self.wavelet = Wavelet(self.last, size)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        kept = (order % every == 0) | (symbols[order - 1] == 0)
        self.sampled, self.positions = Bits(kept), order[kept]
        self.length = len(symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols (none is 0) the rows [start, stop) of the sorted suffixes it opens."""
        n = len(patterns)
        start, stop = np.zeros(n, np.int64), np.full(n, self.length, np.int64)
        alive = np.arange(n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k].astype(np.int64)
            start[alive] = self.start[symbol] + self.wavelet.rank(symbol, start[alive])
            stop[alive] = self.start[symbol] + self.wavelet.rank(symbol, stop[alive])
            alive = alive[start[alive] < stop[alive]]
        return start, np.maximum(start, stop)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of sorted suffixes."""
        out, walked, at, ids = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(ids):
            known = self.sampled.get(at)
            out[ids[known]] = self.positions[self.sampled.rank(at[known])] + walked
            ids, at = ids[~known], at[~known]
            symbol, before = self.wavelet.access(at)
            at = self.start[symbol] + before
            walked += 1
        return out
