"""Approximate search of a text: edit distances as bit vectors, one step a letter for all rows of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a text that one machine word holds; longer ones are searched with whole numbers of any length, row by row.
WORD = 64
#: Letters of all rows that one search holds as an array.
CELLS = 1 << 22


def _masks(text: str) -> dict[str, int]:
    """For each letter of ``text`` the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _ends_of_one(seq: str, text: str, errors: int) -> list[int]:
    """For one sequence the numbers of letters after which a stretch within ``errors`` edits of ``text`` ends."""
    full, top, masks = (1 << len(text)) - 1, 1 << len(text) - 1, _masks(text)
    plus, minus, score, out = full, 0, len(text), []
    for at, c in enumerate(seq, 1):
        eq = masks.get(c, 0)
        flat = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | full & ~(flat | plus), plus & flat
        score += bool(up & top) - bool(down & top)
        up, down = full & up << 1, full & down << 1
        plus, minus = down | full & ~(flat | up), up & flat
        if score <= errors:
            out.append(at)
    return out


def _ends_of_many(seqs: list[str], text: str, errors: int) -> list[list[int]]:
    """The same for sequences of like lengths: a column of letters a step, a word a row."""
    n = np.fromiter(map(len, seqs), np.int64, len(seqs))
    letters = np.array(seqs, dtype=f"<U{max(1, int(n.max()))}").view(np.uint32).reshape(len(seqs), -1).T.copy()
    codes = np.array(sorted(map(ord, set(text))), np.uint32)
    masks = np.array([*(_masks(text)[chr(c)] for c in codes.tolist()), 0], np.uint64)
    slot = np.searchsorted(codes, letters).clip(max=len(codes) - 1)
    eqs = masks[np.where(codes[slot] == letters, slot, len(codes))]  # bits above the text stay without meaning: no step carries down
    top, one = np.uint64(len(text) - 1), np.uint64(1)
    plus, minus = np.full(len(seqs), 2**64 - 1, np.uint64), np.zeros(len(seqs), np.uint64)
    score = np.full(len(seqs), len(text), np.int64)
    near = np.zeros(letters.shape, bool)
    for at, eq in enumerate(eqs):
        flat = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(flat | plus), plus & flat
        score += (up >> top & one).astype(np.int64) - (down >> top & one).astype(np.int64)
        up, down = up << one, down << one
        plus, minus = down | ~(flat | up), up & flat
        near[at] = score <= errors
    near &= np.arange(letters.shape[0])[:, None] < n
    row, at = np.nonzero(near.T)
    return [a.tolist() for a in np.split(at + 1, np.searchsorted(row, np.arange(1, len(seqs))))]


def ends_within(seqs: list[str], text: str, errors: int) -> list[list[int]]:
    """Per sequence, ascending, the numbers of letters after which a stretch within ``errors`` edits of ``text`` ends.

    Time follows the letters of the sequences, not the length of ``text`` (up to a word) or the errors.  Sequences are taken by their lengths, so that one long
    one doesn't widen the others' array.  0 is not told: nothing has been read there.
    """
    if not text:
        raise ValueError("no text to search for")
    out: list[list[int]] = [[]] * len(seqs)
    if len(text) > WORD:
        return [_ends_of_one(s, text, errors) for s in seqs]
    order, first = sorted(range(len(seqs)), key=lambda i: len(seqs[i])), 0
    while first < len(order):
        last, least = first + 1, 2 * len(seqs[order[first]]) + 64
        while last < len(order) and len(seqs[order[last]]) <= least and len(seqs[order[last]]) * (last + 1 - first) <= CELLS:
            last += 1
        block = [seqs[i] for i in order[first:last]]
        # an array drops zero characters at the end of a text, and a lone long text gains nothing from one
        plain = len(block) == 1 or any(s.endswith("\0") for s in block)
        found = [_ends_of_one(s, text, errors) for s in block] if plain else _ends_of_many(block, text, errors)
        for i, ends in zip(order[first:last], found, strict=True):
            out[i] = ends
        first = last
    return out


def near_ends(seq: Column, text: str, errors: int) -> Column:
    """Places (from 1) of the last letters of stretches within ``errors`` edits of ``text``; null for null."""

    @F.pandas_udf("array<int>")
    def ends(seqs: pd.Series) -> pd.Series:
        given = seqs.notna().to_numpy()
        found = pd.Series([None] * len(seqs), index=seqs.index, dtype=object)
        found[given] = pd.Series(ends_within(seqs[given].tolist(), text, errors), index=seqs.index[given], dtype=object)
        return found

    return ends(seq)


def near_starts(seq: Column, text: str, errors: int) -> Column:
    """Places (from 1), descending, of the first letters of such stretches: the ends in the reversed sequence of the reversed text."""
    return F.transform(near_ends(F.reverse(seq), text[::-1], errors), lambda p: F.length(seq) - p + 1)


def approx_place(seq: Column, text: str, errors: int) -> Column:
    """Where the first stretch within ``errors`` edits of ``text`` starts, from 1; 0 without any, and where ``seq`` is null and ``errors`` allowed.

    Without errors it is a plain search.
    """
    if not errors:
        return F.instr(seq, text)
    return F.coalesce(F.array_min(near_starts(seq, text, errors)), F.lit(0))
