"""A minimal perfect hash over 128-bit key hashes: cascading bit arrays, each key alone at its place in one of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import mix

#: Places a remaining key in each level: more make fewer levels and a larger file.
GAMMA = 2
MOST_LEVELS = 64
#: Bits between two entries of the rank table.
RANK_BITS = 512


def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall in a level of ``size`` bits."""
    with np.errstate(over="ignore"):
        return mix(h1 ^ mix(h2 + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(sizes, bits, ranks, slots)``: bits of each level, all levels' bits as 64-bit words, set bits before every
    RANK_BITS, and the slot 0 .. n-1 of each key.  Keys must have distinct hashes."""
    left, sizes, levels = np.arange(len(h1)), [], []
    found_level = np.zeros(len(h1), np.int64)
    found_at = np.zeros(len(h1), np.int64)
    while len(left):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("two keys have one 128-bit hash")
        size = -(-max(GAMMA * len(left), 64) // RANK_BITS) * RANK_BITS
        at = places(h1[left], h2[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        found_level[left[alone]], found_at[left[alone]] = len(sizes), at[alone]
        levels.append(bits)
        sizes.append(size)
        left = left[~alone]
    flat = np.concatenate(levels) if levels else np.zeros(0, bool)
    before = np.r_[0, np.cumsum(flat, dtype=np.int64)]
    starts = np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int64)
    slots = before[starts[found_level] + found_at] if len(h1) else found_at
    return np.array(sizes, "<u8"), np.packbits(flat, bitorder="little").view("<u8"), before[:-1:RANK_BITS].astype("<u8"), slots


def find(h1: np.ndarray, h2: np.ndarray, sizes: np.ndarray, words: Callable[[np.ndarray], np.ndarray], rank: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The slot of each key, -1 where it surely is none.  ``words`` gives the 64-bit words at places, ``rank`` the
    entries of the rank table: of arrays in memory or of a file, of which a key reads a handful."""
    slots = np.full(len(h1), -1, np.int64)
    left, start = np.arange(len(h1)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(left):
            break
        at = start + places(h1[left], h2[left], level, size).astype(np.int64)
        hit = (words(at >> 6) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        if hit.any():
            p = at[hit]
            n = rank(p // RANK_BITS).astype(np.int64)
            first = p // RANK_BITS * (RANK_BITS // 64)
            for k in range(RANK_BITS // 64):
                w = first + k
                full, part = w < p >> 6, w == p >> 6
                if full.any():
                    n[full] += np.bitwise_count(words(w[full])).astype(np.int64)
                if part.any():
                    below = (np.uint64(1) << (p[part] & 63).astype(np.uint64)) - np.uint64(1)
                    n[part] += np.bitwise_count(words(w[part]) & below).astype(np.int64)
            slots[left[hit]] = n
        left, start = left[~hit], start + size
    return slots
