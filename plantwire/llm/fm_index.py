"""FM-index of a sequence of symbols: suffix order, wavelet matrix over its last column, sampled positions.

Symbol 0 ends a run and is no part of a pattern. Suffixes are compared up to the end of their run
and, if equal up to there, by position, so that copies of a run cost no deep comparisons.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 32


class _Bits:
    """Bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        size = (len(bits) // 64 + 1) * 8
        self.words = np.concatenate([packed, np.zeros(size - len(packed), dtype=np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols below ``sigma`` in a sequence, one bit vector for each binary digit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.shifts = range(max(1, (sigma - 1).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            ones = (seq >> shift & 1).astype(bool)
            self.levels.append(_Bits(ones))
            seq = np.concatenate([seq[~ones], seq[ones]])
            self.zeros.append(len(ones) - int(np.count_nonzero(ones)))
        self.start = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before the position beside it."""
        return self._down(symbol, at) - self.start[symbol]

    def symbol_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before it."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits[at].astype(np.int64), bits.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of all suffixes in order; the last symbol of ``text`` must be 0.

    The first sort takes as many symbols as a long holds; then only groups of equal suffixes are
    sorted again, by the rank of what follows twice as far each round.
    """
    width = max(1, (sigma - 1).bit_length())
    far = max(1, 62 // width)
    n, key, open_ = len(text), np.zeros(len(text), dtype=np.int64), np.ones(len(text), dtype=bool)
    for k in range(far):
        symbol = np.zeros(n, dtype=np.int64)
        symbol[: n - k] = text[k:]
        key = key << width | np.where(open_, symbol, 0)
        open_ &= symbol > 0
    order = np.argsort(key, kind="stable")
    key, slots = key[order], np.arange(n)
    head = np.append(True, (key[1:] != key[:-1]) | ~open_[order[1:]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = slots[np.flatnonzero(head)][np.cumsum(head) - 1]
    while True:
        alone = head & np.append(head[1:], True)
        slots, left = slots[~alone], order[slots[~alone]]
        if not len(left):
            return order
        key = rank[left] << 32 | rank[left + far]
        sort = np.argsort(key, kind="stable")
        key, left = key[sort], left[sort]
        order[slots] = left
        head = np.append(True, key[1:] != key[:-1])
        rank[left] = slots[np.flatnonzero(head)][np.cumsum(head) - 1]
        far *= 2


class FMIndex:
    """Index of ``text``, symbols below ``sigma``, whose last symbol is 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_order(text, sigma)
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(text[order - 1], sigma)
        # a walk back never has to pass the end of another run, where equal symbols 0 would not tell runs apart
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.kept, self.sampled = _Bits(kept), order[kept]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from, to) of the suffixes that start with each pattern, by backward search."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.size)
        left = np.arange(len(patterns))
        for at in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[left, at]
            low[left] = self.first[symbol] + self.tree.rank(symbol, low[left])
            high[left] = self.first[symbol] + self.tree.rank(symbol, high[left])
            left = left[low[left] < high[left]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the text of each row's suffix: walk back to the next sampled one."""
        out, left, rows, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(left):
            there = self.kept[rows].astype(bool)
            out[left[there]] = self.sampled[self.kept.rank(rows[there])] + steps
            left, rows = left[~there], rows[~there]
            symbol, before = self.tree.symbol_rank(rows)
            rows, steps = self.first[symbol] + before, steps + 1
        return out
