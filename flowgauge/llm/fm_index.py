"""An FM-index over a shard of words: wavelet-tree ranks, backward search, sampled locations."""

from __future__ import annotations

import numpy as np

#: Every so many text positions one suffix position is kept.
SAMPLE_EVERY = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by doubling. Each 0 is a symbol of its own, so suffixes differ at the first
    one and rounds end with the longest run between zeros."""
    n = len(symbols)
    zeros = symbols == 0
    rank = symbols.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        new = np.empty(n, bool)
        new[0], new[1:] = True, rank[order[1:]] != rank[order[:-1]]
        first = np.flatnonzero(new)
        shared = np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n)))
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))
        slots = np.flatnonzero(shared)  # places of suffixes whose bucket has others
        if not len(slots):
            return order
        ties = order[slots]
        # No tied suffix reaches the end within the step: the text ends with a 0.
        order[slots] = ties[np.lexsort((rank[ties + step], rank[ties]))]
        pair = np.full(n, -1, np.int64)
        pair[order[slots]] = rank[order[slots] + step]
        fresh = rank[order] * (n + 1)
        fresh[slots] += pair[order[slots]]
        rank[order] = fresh
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit level at a time."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(n_symbols - 1, 1).bit_length() - 1, -1, -1):
            bits = (symbols >> bit) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((bit, ones, zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            start_ones, end_ones = ones[start], ones[end]
            start = np.where(up, zeros + start_ones, start - start_ones)
            end = np.where(up, zeros + end_ones, end - end_ones)
        return end - start


class FmIndex:
    """``symbols``: words numbered from 1; 0 parts what no phrase may span, and comes last."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # of the first suffix: the closing 0
        self.before = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=n_symbols), out=self.before[1:])
        self.tree = WaveletMatrix(self.last, n_symbols)
        # A walk to the left ends at a sampled place, at the latest after a 0.
        self.sampled = (order % SAMPLE_EVERY == 0) | (self.last == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.size = len(symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases (rows of symbols, right-aligned), by backward search."""
        width = phrases.shape[1]
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for step in range(width):
            alive = alive[(lengths[alive] > step) & (lo[alive] < hi[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, width - 1 - step]
            lo[alive] = self.before[symbol] + self.tree.rank(symbol, lo[alive])
            hi[alive] = self.before[symbol] + self.tree.rank(symbol, hi[alive])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking left to the nearest sample."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol = self.last[rows[walking]]
            rows[walking] = self.before[symbol] + self.tree.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.sample_at[rows]] + steps
