"""Minimal perfect hashing of 64-bit keys by levels of bit arrays.

At each level the keys that are left fall on a bit array of twice their number; those that fall alone stay there, the
others go on to the next level. A key's number is the rank of its bit, so the numbers of n keys are 0 to n - 1 at about
3.7 bits a key. Keys outside of the set get some number or none: whoever looks up compares the key kept there.

Keys are dealt over shards by their hash, each built by itself; ``Hashed`` looks up in the shards of one block at once.
"""

from __future__ import annotations

import numpy as np

from sensorloom.llm.token_table import mix

SPREAD = 2


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64), 71) >> np.uint64(32)).astype(np.int64) * shards >> 32


def build(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Bits of each level (multiples of 64), and the levels' bits in 64-bit words."""
    sizes, words, left, level = [], [], keys.astype(np.uint64), 0
    while len(left):
        m = -(-SPREAD * len(left) // 64) * 64
        at = (mix(left, 100 + level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left, level = left[~alone[at]], level + 1
    return sizes, (np.concatenate(words) if words else np.empty(0, "<u8")).tobytes()


class Hashed:
    """Looks up keys of the shards first, first + 1 ... of ``shards``."""

    def __init__(self, first: int, shards: int, built: list[tuple[list[int], bytes]]):
        self.first, self.shards = first, shards
        self.sizes = np.zeros((len(built), max((len(s) for s, _ in built), default=0)), np.int64)
        for k, (sizes, _) in enumerate(built):
            self.sizes[k, : len(sizes)] = sizes
        self.words = np.frombuffer(b"".join(w for _, w in built), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.r_[0, np.cumsum(ones)]
        ends = np.cumsum(self.sizes.ravel()).reshape(self.sizes.shape) if self.sizes.size else self.sizes
        self.offsets = ends - self.sizes
        starts = self.offsets[:, 0] if self.sizes.size else np.zeros(len(built), np.int64)
        #: Where each shard's numbers begin, with the end.
        self.bounds = np.r_[self.before[starts // 64], self.before[-1]]

    def __len__(self) -> int:
        return int(self.before[-1])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it can't be in the block."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        shard = shard_of(keys, self.shards) - self.first
        left = np.flatnonzero((shard >= 0) & (shard < len(self.sizes)))
        for level in range(self.sizes.shape[1]):
            m = self.sizes[shard[left], level]
            left, m = left[m > 0], m[m > 0]
            if not len(left):
                break
            at = self.offsets[shard[left], level] + (mix(keys[left], 100 + level) % m.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            some = left[hit]
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[some] = self.before[at[hit] >> 6] + below
            left = left[~hit]
        return out
