"""FM-index over integers: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled
suffix positions. All queries are vectorised over patterns and rows."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; every separator counts as a symbol of its own, smaller than all others, by position."""
    n = len(text)
    x = text.astype(np.int64)
    apart = np.flatnonzero(x == SEPARATOR)
    x += len(apart)
    x[apart] = np.arange(len(apart))
    order = np.argsort(x, kind="stable")
    first = np.ones(n, bool)
    first[1:] = x[order[1:]] != x[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = _crowded(np.arange(n), first)
    step = 1
    while len(open_):
        at = order[open_]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[at]
        sort = np.lexsort((second, group))
        at, second, group = at[sort], second[sort], group[sort]
        order[open_] = at
        first = np.ones(len(at), bool)
        first[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        open_ = _crowded(open_, first)
        step *= 2
    return order


def _crowded(slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Slots of groups with more than one member."""
    alone = first & np.append(first[1:], True)
    return slots[~alone]


class WaveletMatrix:
    """Rank and access over a sequence of small integers, a bit of them per level."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        v = values.astype(np.int32)
        for level in reversed(range(self.levels)):
            bit = (v >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        self.begin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = self.ones[k][place]
            bit = (symbol >> (self.levels - 1 - k)) & 1
            place = np.where(bit == 1, self.zeros[k] + one, place - one)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbol, place) - self.begin[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and how often each occurs before its place."""
        symbol = np.zeros(len(place), np.int64)
        for k in range(self.levels):
            one = self.ones[k][place]
            bit = self.ones[k][place + 1] - one
            symbol = symbol * 2 + bit
            place = np.where(bit == 1, self.zeros[k] + one, place - one)
        return symbol, place - self.begin[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample_every: int = 8):
        """text: integers below `symbols`; SEPARATOR divides segments, and no pattern may contain it."""
        self.n = len(text)
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], SEPARATOR)
        self.tree = WaveletMatrix(before, symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        # positions are sampled regularly and at every start of a segment, so that a walk never crosses a separator
        sampled = (order % sample_every == 0) | (before == SEPARATOR)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int64)
        self.samples = order[sampled]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern, by backward search."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        active = np.flatnonzero(lengths > 0)
        for step in range(1, patterns.shape[1] + 1 if len(lengths) else 1):
            active = active[(lengths[active] >= step) & (low[active] < high[active])]
            if not len(active):
                break
            symbol = patterns[active, lengths[active] - step]
            low[active] = self.less[symbol] + self.tree.rank(symbol, low[active])
            high[active] = self.less[symbol] + self.tree.rank(symbol, high[active])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows, walking back to the nearest sampled one."""
        found, rows, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            slot = self.sampled[here]
            hit = self.sampled[here + 1] > slot
            found[left[hit]] = self.samples[slot[hit]] + steps
            left = left[~hit]
            if len(left):
                symbol, rank = self.tree.access(rows[left])
                rows[left] = self.less[symbol] + rank
            steps += 1
        return found
