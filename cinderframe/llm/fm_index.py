"""A compressed full-text index over words: Burrows-Wheeler transform, wavelet matrix, matching statistics.

Words are small integers. The indexed text is a list of segments, each closed by a separator that
no search crosses. Backward search finds the rows of the suffix array that start with a pattern,
one word to the left a step; every step works on all patterns at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """Number of ones in front of each position."""
        at = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    """A sequence of integers below 2^bits as one bit vector a level; counts a value before a position."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels: list[tuple[int, int, Bits]] = []
        for shift in range(bits - 1, -1, -1):
            one = (sequence >> shift) & 1 == 1
            self.levels.append((shift, int(len(one) - one.sum()), Bits(one)))
            sequence = np.concatenate((sequence[~one], sequence[one]))

    def places(self, values: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Where ``upto`` ends among the value's own stretch of the last level."""
        at = upto
        for shift, zeros, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((values >> shift) & 1 == 1, zeros + ones, at - ones)
        return at


def suffix_ranks(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The suffix array, and for each power of two below ``longest`` the ranks by so many symbols.

    Symbols of which each suffix holds one that occurs once within ``longest`` symbols order it fully.
    """
    n, width, ranks = len(symbols), 1, {}
    order = np.argsort(symbols, kind="stable")
    key = symbols
    while True:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))) if n else 0
        ranks[width] = rank.astype(np.int32)
        if width >= longest or n == 0 or rank[order[-1]] == n - 1:
            return order, ranks
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        width *= 2


class FMIndex:
    """Segments of words (numbered from 1) under backward search; matches count up to ``depth`` words."""

    def __init__(self, segments: list[np.ndarray], sigma: int, depth: int):
        k = len(segments)
        sizes = np.array([len(s) for s in segments], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        text = np.zeros(int(sizes.sum()) + k, np.int64)
        ends = self.starts + sizes
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.concatenate(segments) if k else []
        symbols = text + k - 1  # separators come first, each by itself
        symbols[ends] = np.arange(k)
        self.sa, ranks = suffix_ranks(symbols, int(sizes.max(initial=0)) + 1)
        self.text, self.n, self.depth = text, len(text), depth
        before = np.where(self.sa > 0, text[self.sa - 1], 0) if self.n else text
        self.wavelet = WaveletMatrix(before, max(1, int(sigma).bit_length()))
        # where a word's rows begin, less where its stretch of the last level begins
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))[:-1]
        self.first = self.first - self.wavelet.places(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        self.common = self._common(ranks)
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _common(self, ranks: dict[int, np.ndarray]) -> np.ndarray:
        """Words that each row shares with the row above it, up to ``depth``; 0 at both ends."""
        shared = np.zeros(self.n + 1, np.int64)
        if self.n:
            a, b = self.sa[1:].copy(), self.sa[:-1].copy()
            for width in sorted((w for w in ranks if w <= self.depth), reverse=True):
                inside = (a < self.n) & (b < self.n)
                same = inside & (ranks[width][np.minimum(a, self.n - 1)] == ranks[width][np.minimum(b, self.n - 1)])
                shared[1:-1] += np.where(same, width, 0)
                a, b = a + width * same, b + width * same
        return np.minimum(shared, self.depth)

    def blocks(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the first row and the end of the rows that share ``depth`` words with it."""
        if depth not in self._blocks:
            cut = self.common < depth
            rows = np.arange(self.n + 1)
            low = np.maximum.accumulate(np.where(cut, rows, 0))
            high = np.minimum.accumulate(np.where(cut, rows, self.n)[::-1])[::-1]
            self._blocks[depth] = low.astype(np.int32), high.astype(np.int32)
        return self._blocks[depth]

    def widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share ``depth`` words with the rows of an interval."""
        low, high = low.copy(), high.copy()
        for d in np.unique(depth).tolist():
            at = depth == d
            first, end = self.blocks(d)
            low[at], high[at] = (first[low[at]], end[high[at]]) if d else (0, self.n)
        return low, high

    def matching_statistics(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, row) for each place of ``words``: the longest match that starts there and a row that has it.

        ``words``: flat patterns, 0 for a word that the index lacks; a pattern is words[start:end], and a
        match doesn't leave it. Lengths stop at ``depth``. Patterns are read right to left; a match that
        can't take a word on its left gives up words on its right until it can.
        """
        length, row = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(ends > starts)
        at, stop = ends[live] - 1, starts[live]
        low, high, has = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64), np.zeros(len(live), np.int64)
        while len(live):
            full = has == self.depth
            if full.any():
                low[full], high[full] = self.widen(low[full], high[full], np.full(int(full.sum()), self.depth - 1))
                has[full] = self.depth - 1
            word = words[at]
            both = self.wavelet.places(np.concatenate((word, word)), np.concatenate((low, high)))
            new_low, new_high = self.first[word] + both[: len(word)], self.first[word] + both[len(word) :]
            fits = (word > 0) & (new_low < new_high)
            low, high, has = np.where(fits, new_low, low), np.where(fits, new_high, high), has + fits
            shrink = ~fits & (has > 0)
            if shrink.any():
                has[shrink] = np.maximum(self.common[low[shrink]], self.common[high[shrink]])
                low[shrink], high[shrink] = self.widen(low[shrink], high[shrink], has[shrink])
            done = ~shrink
            length[at[done]], row[at[done]] = has[done], low[done]
            at = at - done
            more = at >= stop
            live, at, stop, low, high, has = (x[more] for x in (live, at, stop, low, high, has))
        return length, row
