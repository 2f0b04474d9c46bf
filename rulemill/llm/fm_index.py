"""FM-index over a sequence of symbols in numpy: suffix order, wavelet ranks, backward search, sampled suffix positions.

Symbols are integers from 0 on. 0 separates texts: it occurs in no phrase, and two separators are never alike for the order, so
no match and no comparison crosses one.
"""
from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions ordered by their suffixes, by doubling; only suffixes whose rank is still shared are sorted again."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    ends = symbols == 0
    n_ends = int(ends.sum())
    value = symbols.astype(np.int64) + n_ends
    value[ends] = np.arange(n_ends)
    bits = max(int(value.max() + 1).bit_length(), 1)
    width = max(1, min(62 // bits, 4))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[:n - k] += value[k:] + 1
    order = np.argsort(key, kind="stable")
    lead = np.ones(n, bool)
    lead[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(lead, np.arange(1, n + 1), 0))
    alone = np.append(lead[1:], True) & lead
    open_places, sorted_to = np.flatnonzero(~alone), width
    while len(open_places):
        members = order[open_places]
        first = rank[members]
        following = rank[np.minimum(members + sorted_to, n)]
        by_pair = np.lexsort((following, first))
        members, first, following = members[by_pair], first[by_pair], following[by_pair]
        order[open_places] = members
        new = np.ones(len(members), bool)
        new[1:] = (first[1:] != first[:-1]) | (following[1:] != following[:-1])
        at = np.maximum.accumulate(np.where(new, open_places + 1, 0))
        rank[members] = at
        alone = new & np.append(new[1:], True)
        open_places = open_places[~alone]
        sorted_to *= 2
    return order


class WaveletRanks:
    """How often a symbol occurs before a position, by one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(int(n_symbols - 1).bit_length(), 1)
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level & 1).astype(bool)
            ones = np.zeros(len(current) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(current) - int(ones[-1]))
            current = np.concatenate([current[~bit], current[bit]])
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            before = ones[places].astype(np.int64)
            places = np.where(symbols >> (self.bits - 1 - depth) & 1, zeros + before, places - before)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self._down(symbols, places) - self.begin[symbols]


class FmIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        self.n = len(symbols)
        # The text is taken as a circle, so that every position has one before it; position 0 is always sampled.
        self.before = symbols[order - 1] if self.n else symbols
        counts = np.bincount(symbols, minlength=n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.ranks = WaveletRanks(self.before, n_symbols)
        # Suffix positions are kept at every sample-th position and behind separators.
        kept = (order % sample == 0) | (self.before == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of phrases (right-aligned symbols) the range of suffixes that begin with it; empty if there is none.

        A phrase with a symbol the index does not know (below 1) has no match.
        """
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        if not self.n or not len(phrases):
            return low, high
        width = phrases.shape[1]
        used = np.arange(width) >= width - lengths[:, None]
        alive = np.flatnonzero(((phrases > 0) | ~used).all(axis=1) & (lengths > 0))
        last = phrases[alive, width - 1]
        low[alive], high[alive] = self.first[last], self.first[last + 1]
        for k in range(1, width):
            alive = alive[low[alive] < high[alive]]
            going = alive[lengths[alive] > k]
            if not len(going):
                break
            symbol = phrases[going, width - 1 - k]
            low[going] = self.first[symbol] + self.ranks.rank(symbol, low[going])
            high[going] = self.first[symbol] + self.ranks.rank(symbol, high[going])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows of the suffix order: steps back until a sampled one is met."""
        out = np.zeros(len(rows), np.int64)
        rows = rows.astype(np.int64).copy()
        left, steps = np.arange(len(rows)), 0
        while len(left):
            at = rows[left]
            met = self.kept[at + 1] > self.kept[at]
            out[left[met]] = self.positions[self.kept[at[met]]] + steps
            left = left[~met]
            symbol = self.before[rows[left]]
            rows[left] = self.first[symbol] + self.ranks.rank(symbol, rows[left])
            steps += 1
        return out
