"""An FM-index over a sequence of numbered words.

Symbol 0 separates runs of words; a phrase never holds it.  The suffix order is made by
prefix doubling with every separator distinct, so suffixes are told apart within their run.
The Burrows-Wheeler transform is kept as a wavelet matrix, whose ranks drive the backward
search; suffix positions are sampled at each run's first word and every ``sample``-th position, and an
occurrence is located by walking back to the next sampled one.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        seq = seq.astype(np.int32)
        for level in range(self.bits):
            b = (seq >> (self.bits - 1 - level)) & 1
            cum = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(b, out=cum[1:])
            self.ones.append(cum)
            self.zeros.append(len(seq) - int(cum[-1]))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            one = self.ones[level][i]
            i = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before i."""
        return self._follow(symbol, i) - self._follow(symbol, np.zeros_like(i))


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        n = self.n = len(seq)
        at = np.arange(n, dtype=np.int64)
        rank = np.unique(np.where(seq == 0, at, n + seq.astype(np.int64)), return_inverse=True)[1].astype(np.int64)
        step = 1
        while n and rank.max() < n - 1:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
            step *= 2
        suffix = np.empty(n, np.int64)
        suffix[rank] = at
        self.bwt = seq[suffix - 1].astype(np.int32)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))]).astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, sigma)
        self.marked = (suffix % sample == 0) | (self.bwt == 0) | (suffix == 0)
        self.before = np.concatenate([[0], np.cumsum(self.marked)])
        self.sampled = suffix[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the phrases, one per row of symbols > 0."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            c = phrases[live, j].astype(np.int64)
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence in the ranges."""
        count = hi - lo
        phrase = np.repeat(np.arange(len(lo)), count)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        back = np.zeros(len(row), np.int64)
        todo = np.flatnonzero(~self.marked[row]) if len(row) else row
        while len(todo):
            c = self.bwt[row[todo]].astype(np.int64)
            row[todo] = self.less[c] + self.tree.rank(c, row[todo])
            back[todo] += 1
            todo = todo[~self.marked[row[todo]]]
        return phrase, self.sampled[self.before[row]] + back
