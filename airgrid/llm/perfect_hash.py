"""A minimal perfect hash in numpy: levels of bit arrays in which a key owns the bit that no other key hits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from airgrid.llm.common import mix64

#: bits per remaining key on each level
GAMMA = 2.0


def _positions(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(high ^ mix64(low + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))) % np.uint64(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    """Maps each of n distinct 128-bit keys to its own number below n; other keys to anything, or to -1."""

    sizes: np.ndarray  # bits per level
    words: np.ndarray  # the levels' bits, 64 to a word

    def __post_init__(self) -> None:
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(high):
            bits = max(64, -(-int(GAMMA * len(high)) // 64) * 64)
            at = _positions(high, low, level, bits)
            alone = np.bincount(at, minlength=bits)[at] == 1
            flags = np.zeros(bits, dtype=np.uint8)
            flags[at[alone]] = 1
            sizes.append(bits)
            words.append(np.packbits(flags, bitorder="little").view(np.uint64))
            high, low, level = high[~alone], low[~alone], level + 1
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found, open_, start = np.full(len(high), -1, dtype=np.int64), np.arange(len(high)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = _positions(high[open_], low[open_], level, bits)
            word, bit = start + (at >> 6), (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[hit]] = (self._before[word] + below)[hit]
            open_, start = open_[~hit], start + bits // 64
        return found
