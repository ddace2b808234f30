"""A full-text index over integer symbols: suffix order, wavelet-tree ranks, sampled suffix positions.

Everything works on whole NumPy vectors, so a search runs all patterns of one length at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. The last symbol must be smaller than all others and unique.

    Only suffixes whose rank is still shared are sorted again, so long copies cost rounds but not whole sorts.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    heads = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    step = 1
    while True:
        shared = np.flatnonzero(~(heads & np.r_[heads[1:], True]))
        if not len(shared):
            return order
        at = order[shared]
        behind = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        again = np.lexsort((behind, rank[at]))
        at, behind = at[again], behind[again]
        order[shared] = at
        group = rank[at]
        new = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        heads[shared] = new
        rank[at] = np.maximum.accumulate(np.where(new, shared, 0))
        step *= 2


class Bits:
    """A bit vector with constant-time rank: packed 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Ranks over a large alphabet, one bit vector for each bit of a symbol (zeros of each level stand before its ones)."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            symbols = symbols[np.argsort(ones, kind="stable")]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        begin = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            b1, a1 = bits.rank(begin), bits.rank(at)
            one = (symbol >> bit) & 1 == 1
            begin, at = np.where(one, zeros + b1, begin - b1), np.where(one, zeros + a1, at - a1)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one, before = bits.get(at), bits.rank(at)
            symbol |= one << bit
            at = np.where(one == 1, zeros + before, at - before)
        return symbol


class FMIndex:
    """Index of one shard. Symbols are 1..size-1; symbol 0 is appended as the end."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = 16):
        text = np.r_[symbols, 0].astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], size)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        marked = order % sample == 0
        self.marked, self.sampled = Bits(marked), order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) that begin with each row of ``patterns`` (all of one length), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, k].astype(np.int64)
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk backwards to the next sampled position."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            known = self.marked.get(rows) == 1
            out[left[known]] = self.sampled[self.marked.rank(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            if len(rows):
                symbol = self.tree.access(rows)
                rows = self.first[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out
