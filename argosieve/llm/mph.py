"""Minimal perfect hashing by levels of bit arrays: n distinct 64-bit keys get the slots 0 to n-1.

On each level a key goes to one bit; keys that are alone there stay, the others go on to the next level. The slot is the
rank of the key's bit. About 3.7 bits a key with gamma 2.
"""

from __future__ import annotations

import numpy as np

from argosieve.llm.common import mix64

_MAX_LEVELS = 200


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix64(keys, level + 1) >> np.uint64(32)
    return ((h * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


class MinimalPerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray, n: int):
        self.sizes, self.words, self.ranks, self.n = sizes, words, ranks, n

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        """``keys`` must be distinct uint64 values; an empty array gives an index without slots."""
        left, n = keys.astype(np.uint64), len(keys)
        sizes, words = [], []
        while left.size:
            if len(sizes) >= _MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = int(max(64, np.ceil(gamma * left.size / 64) * 64))
            at = _place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
        w = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]).astype(np.int64)
        return cls(np.array(sizes, np.int64), w, ranks[:-1], n)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key. A key that was not built in gets -1 or any slot; compare stored fingerprints to tell."""
        out = np.full(len(keys), -1, np.int64)
        left, idx, base = keys.astype(np.uint64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not idx.size:
                break
            at = _place(left, level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            w = self.words[word]
            hit = ((w >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[idx[hit]] = self.ranks[word[hit]] + below
            left, idx = left[~hit], idx[~hit]
            base += size >> 6
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"mph_sizes": self.sizes, "mph_words": self.words, "mph_ranks": self.ranks, "mph_n": np.array([self.n], np.int64)}

    @classmethod
    def from_arrays(cls, a: dict[str, np.ndarray]) -> MinimalPerfectHash:
        return cls(a["mph_sizes"], a["mph_words"], a["mph_ranks"], int(a["mph_n"][0]))
