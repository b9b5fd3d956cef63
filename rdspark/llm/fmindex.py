"""A compressed full-text index (FM-index) over word ids: Burrows-Wheeler transform in a wavelet matrix with packed bits.

Suffixes are ordered by their first ``DEPTH`` symbols, which is all that backward search for patterns of up to DEPTH symbols needs.
All searches of a shard run in lock step, as NumPy arrays of intervals.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


def _rank_pairs(a: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of (a[i], a[i + shift]); beyond the end counts as least."""
    n = len(a)
    key = a.astype(np.int64) * (n + 1)
    key[:n - shift] += a[shift:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    s = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
    return rank


def ranks(text: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Rank of each suffix by its first k symbols, for powers of two up to DEPTH and for ``lengths``."""
    out = {1: text.astype(np.int64)}
    k = 1
    while k < DEPTH:
        out[2 * k] = _rank_pairs(out[k], k) if len(text) > k else out[k]
        k *= 2
    for n in lengths:
        base = 1 << (n.bit_length() - 1)
        if n not in out:      # two overlapping stretches cover n symbols
            out[n] = _rank_pairs(out[base], n - base) if len(text) > n - base else out[base]
    return out


class Bits:
    """Packed bits with counts before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before position i."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low).astype(np.int64)


class FMIndex:
    """Index over ``text``, small non-negative integers (0 parts the pieces)."""

    def __init__(self, text: np.ndarray, window: int):
        by = ranks(text, (window,))
        self.n, self.suffixes = len(text), np.argsort(by[DEPTH], kind="stable")
        self.place = np.empty(self.n, np.int64)      # of each suffix
        self.place[self.suffixes] = np.arange(self.n)
        symbols = text[self.suffixes - 1]
        sigma = int(text.max(initial=0)) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.levels: list[Bits] = []
        self.depth = max(1, (sigma - 1).bit_length())
        rest = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (rest >> level) & 1
            self.levels.append(Bits(bit.astype(bool)))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        # Ends of the stretches of suffixes that share their first ``window`` symbols.
        r = by[window][self.suffixes]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if self.n else np.zeros(0, int)
        self.group_start = np.repeat(starts, np.diff(np.r_[starts, self.n])) if self.n else starts
        self.group_end = np.repeat(np.r_[starts[1:], self.n], np.diff(np.r_[starts, self.n])).astype(np.int64) if self.n else starts

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the transform."""
        begin = np.zeros_like(i)
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = bits.ones(begin), bits.ones(i)
            begin, i = np.where(one, bits.zeros + a, begin - a), np.where(one, bits.zeros + b, i - b)
        return i - begin

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol on the left."""
        at = self.first[symbol]
        return at + self.occurrences(symbol, low), at + self.occurrences(symbol, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``window`` symbols of longer matches."""
        return self.group_start[low], self.group_end[low]


def matching_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Streams pieces text[start:end] through the index from their right ends. Returns (position, least position with the same window) for
    every window of every piece: the matching statistics cut off at ``window``."""
    least = np.minimum.reduceat(index.suffixes, np.unique(index.group_start)) if index.n else np.zeros(0, int)
    group = np.cumsum(np.r_[0, np.diff(index.group_start) != 0]) if index.n else np.zeros(0, int)
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), index.n)
    matched, at = np.zeros(len(starts), np.int64), ends - 1
    active = np.arange(len(starts))
    where, found = [], []
    while len(active):
        active = active[at[active] >= starts[active]]
        if not len(active):
            break
        low[active], high[active] = index.back(text[at[active]], low[active], high[active])
        matched[active] += 1
        over = active[matched[active] >= window]
        if len(over):
            low[over], high[over] = index.shorten(low[over])
            matched[over] = window
            where.append(at[over].copy())
            found.append(least[group[low[over]]])
        at[active] -= 1
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(where), np.concatenate(found)
