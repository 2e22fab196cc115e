"""Minimal perfect hashing of keys to 0..n-1, by levels of bit arrays, built and read with array operations."""

from __future__ import annotations

import numpy as np
import xxhash

FACTOR = 1.7  # bits of a level for each key that reaches it
LEVELS = 64


def key_hashes(keys: list) -> np.ndarray:
    """Two 64-bit hashes of each key (of its text; null has a text of its own), as columns."""
    out = np.empty((len(keys), 2), np.uint64)
    for i, k in enumerate(keys):
        h = xxhash.xxh3_128_intdigest(b"\0null" if k is None else str(k).encode())
        out[i] = h >> 64, h & (1 << 64) - 1
    return out


def _spot(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = h[:, 0] + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) * h[:, 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """A level sets the bits that exactly one remaining key falls on; a key's number is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        before = 0
        self.bits, self.ranks = [], []
        for words in levels:
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")
            counts = np.cumsum(bits.reshape(-1, 64).sum(1), dtype=np.int64)
            self.ranks.append(before + np.concatenate(([0], counts[:-1])).astype(np.int64))
            before += int(counts[-1])
        self.n = before

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """``h``: distinct rows of :func:`key_hashes`."""
        levels = []
        for level in range(LEVELS):
            if not len(h):
                return cls(levels)
            bits = 64 * max(1, int(-(-FACTOR * len(h) // 64)))
            spot = _spot(h, level, bits)
            alone = np.bincount(spot, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            h = h[~alone[spot]]
        raise ValueError("keys with equal hashes")

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each key; a key that was not there gets -1 or any number (compare fingerprints)."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            spot = _spot(h[left], level, 64 * len(words))
            word, bit = words[spot >> 6], (spot & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = word[there] & ((np.uint64(1) << bit[there]) - np.uint64(1))
            out[left[there]] = ranks[spot[there] >> 6] + np.bitwise_count(below)
            left = left[~there]
        return out
