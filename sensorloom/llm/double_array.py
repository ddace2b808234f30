"""Double-array tries over word numbers, built and walked by whole arrays.

A word's number is two symbols, its high part and its low 8 bits, so a node has few children at each step. A node at slot s
has its child of symbol c at slot ``base[s] + c``, where ``check`` names s as the parent. Slots are found by trying random
places for all nodes of similar size at once, large nodes first.
"""

from __future__ import annotations

import numpy as np

LOW = 8


class DoubleArray:
    """``base``, ``check`` and ``number`` (of the sequence that ends at a slot, else -1); the root is slot 0."""

    def __init__(self, base: np.ndarray, check: np.ndarray, number: np.ndarray):
        self.base, self.check, self.number = base, check, number

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states go on by their symbols, and where to."""
        to = self.base[state] + symbol
        good = np.flatnonzero(self.check[to] == state)
        return good, to[good]

    def follow(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states go on by a word each, and where to."""
        some, middle = self.step(state, word >> LOW)
        good, to = self.step(middle, word[some] & ((1 << LOW) - 1))
        return some[good], to


def build(words: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of distinct sequences: ``words`` has one in each row, the first ``lengths`` of a row count."""
    n = len(words)
    node, nodes = np.zeros(n, np.int64), 1
    parents, by = [], []
    for d in range(2 * words.shape[1]):
        rows = np.flatnonzero(2 * lengths > d)
        if not len(rows):
            break
        own = words[rows, d // 2].astype(np.int64)
        kinds, which = np.unique(node[rows] << 32 | (own & ((1 << LOW) - 1) if d % 2 else own >> LOW), return_inverse=True)
        parents.append((kinds >> 32).astype(np.int32))
        by.append((kinds & 0xFFFFFFFF).astype(np.int32))
        node[rows] = nodes + which
        nodes += len(kinds)
    ends = node
    parent, symbol = np.concatenate(parents), np.concatenate(by)  # of nodes 1, 2 ...
    base_of = _placed(parent, symbol, nodes)
    slot = np.zeros(nodes, np.int32)
    slot[1:] = base_of[parent] + symbol
    size = int(slot.max()) + int(symbol.max()) + 2
    size = max(size, int(base_of.max()) + int(symbol.max()) + 2)
    base, check, number = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot] = base_of
    check[slot[1:]] = slot[parent]
    number[slot[ends]] = np.arange(n)
    return DoubleArray(base, check, number)


def _placed(parent: np.ndarray, symbol: np.ndarray, nodes: int) -> np.ndarray:
    """A base for each node so that no two children share a slot. Children stand together by parent."""
    rng = np.random.default_rng(7)
    sizes = np.bincount(parent, minlength=nodes)
    first = np.r_[0, np.cumsum(sizes)][:-1]
    inner = np.flatnonzero(sizes)
    inner = inner[np.argsort(-sizes[inner], kind="stable")]
    room = 3 * len(parent) // 2 + int(symbol.max()) + 64
    taken, claim = np.zeros(room, bool), np.full(room, -1, np.int32)
    taken[0] = True
    base = np.zeros(nodes, np.int32)
    a = 0
    while a < len(inner):
        # Nodes of about one size, with no more children than an eighth of the slots.
        b = a + max(1, int(np.searchsorted(np.cumsum(sizes[inner[a:]]), len(taken) // 8)))
        b = min(b, a + int(np.searchsorted(-sizes[inner[a:]], -(sizes[inner[a]] // 2), "right")))
        left, tries = inner[a : max(b, a + 1)], 0
        a += len(left)
        while len(left):
            many = sizes[left]
            starts = np.r_[0, np.cumsum(many)][:-1]
            at = np.repeat(first[left] - starts, many) + np.arange(many.sum())
            tried = rng.integers(1, len(taken) - int(symbol.max()), len(left))
            slots = np.repeat(tried, many) + symbol[at]
            who = np.repeat(np.arange(len(left)), many)
            free = ~np.logical_or.reduceat(taken[slots], starts)
            of_free = free[who]
            claim[slots[of_free]] = who[of_free]
            good = free & np.logical_and.reduceat(claim[slots] == who, starts)
            base[left[good]] = tried[good]
            taken[slots[good[who]]] = True
            left, tries = left[~good], tries + 1
            if tries % 60 == 0:
                taken = np.r_[taken, np.zeros(len(taken) // 2, bool)]
                claim = np.r_[claim, np.full(len(taken) - len(claim), -1, np.int32)]
    return base


class Numbers:
    """Numbers of 64-bit hashes: their places among sorted distinct ones, found by their high bits."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.shift = np.uint64(64 - max(1, int(len(known)).bit_length() + 1))
        self.starts = np.searchsorted(known, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)
        self.steps = int(np.diff(np.r_[self.starts, len(known)]).max(initial=0))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.known):
            return out
        at = self.starts[(hashes >> self.shift).astype(np.int64)]
        for k in range(self.steps):
            place = np.minimum(at + k, len(self.known) - 1)
            good = self.known[place] == hashes
            out[good] = place[good]
        return out
