"""Packing: bounded-space online packing of token sequences into windows of a fixed size."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stage, tidy

#: Only these characters take the fast path, where lower case and white space are the same everywhere.
_PLAIN = r"[\t\n\r\x20-\x7e¡-ɏ]*"
_SPECIAL = "<|"
# The steps before the model that the fast path stands for, as a tokenizers file states them.
_KNOWN = {
    "truncation": None, "padding": None, "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class _Remembered(dict):
    """``make(key)`` of each key, kept until there are ``most`` of them, then forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b) if prints[b] else chr(256 + b - sum(prints[:b])) for b in range(256)]


class WordEncoder:
    """Token ids of a text by a word-level tokenizers file, each distinct word encoded once.

    The tokenizer splits a text at white space, then by its pattern, and encodes each piece on its own, so
    the ids of a text are those of its pieces joined.  A text that holds a character outside Latin letters
    and ASCII, or what may be a special token, is handed to the tokenizer whole.
    """

    def __init__(self, path: str, most_words: int = 150_000, most_pieces: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        #: Whether the file splits and lower-cases as this class does; if not, every text is handed to the tokenizer whole.
        self.fast = all(made.get(k) == v for k, v in _KNOWN.items()) and made["model"]["type"] == "BPE" and all(
            t["content"].startswith(_SPECIAL) for t in made["added_tokens"])
        self.plain = re.compile(_PLAIN)
        some = [chr(c) for c in range(0x21, 0x250)]
        letter, number = ("".join(c for c in some if unicodedata.category(c)[0] == k) for k in "LN")
        # Fixed value: the pattern of the tokenizer's own splitter, letters and numbers those of plain text.
        split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+").findall
        tokenize, letters = self.tokenizer.model.tokenize, _byte_letters()

        def piece_ids(piece: str) -> bytes:
            raw = piece if piece.isascii() else "".join([letters[b] for b in piece.encode()])
            return array("I", [t.id for t in tokenize(raw)]).tobytes()

        def word_ids(word: str) -> bytes:
            return piece(word) if word.isalpha() else b"".join(map(piece, split(word)))

        piece = _Remembered(piece_ids, most_pieces).__getitem__
        self.word = _Remembered(word_ids, most_words).__getitem__

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text (null: none)."""
        if not text:
            return b""
        if not self.fast or _SPECIAL in text or not self.plain.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.word, text.lower().split()))


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder a Python worker, so that what it remembers serves all its tasks."""
    return WordEncoder(path)


class OpenWindows:
    """At most ``space`` open windows; a piece goes where it leaves the least room."""

    def __init__(self, capacity: int, space: int):
        self.capacity, self.space = capacity, space
        self.by_room: list[tuple[int, int]] = []  # (room, window), sorted
        self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece; when it fits none of ``space`` windows, the fullest is closed."""
        if length == self.capacity:
            self.next += 1
            return self.next - 1, 0
        k = bisect_left(self.by_room, (length, -1))
        if k < len(self.by_room):
            room, window = self.by_room.pop(k)
        else:
            if len(self.by_room) == self.space:
                self.by_room.pop(0)
            room, window = self.capacity, self.next
            self.next += 1
        if room > length:
            insort(self.by_room, (room - length, window))
        return window, self.capacity - room


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("part", pa.int64()), ("win", pa.int64()), ("offset", pa.int64()), ("open_used", pa.int64()),
])


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, space: int = 64, end_id: int = 2,
         merge_group: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids by the tokenizers file ``tokenizer`` and ``end_id``; it is cut every
    ``capacity`` tokens and what remains is one piece.  Each partition packs its own pieces as they come:
    ``space`` windows are open, a piece goes into the one it fits best, and when it fits none the
    fullest is emitted and a new one opened.  The windows still open at a partition's end, at most
    ``space``, are merged by best-fit decreasing over groups of ``merge_group`` partitions.  That leaves at
    most one sequence a group that is no more than half full; those are merged over groups of groups
    until one group is left.  No step sees more than ``space * merge_group`` windows of a group.

    Returns one row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  Each
    token is in exactly one piece; ``offset`` is gapless from 0 in each sequence.  A null or empty text is
    one piece of ``end_id`` alone.  Ids must be integers; a null id stays null.  A long text takes as
    many whole windows as it fills.  No rows give no rows.
    """
    src = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, windows = encoder_of(tokenizer), OpenWindows(capacity, space)
        held: dict[int, list] = {}  # rows of windows still open: their pieces, not their tokens

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(_PIECES), _PIECES, strict=True)],
                schema=_PIECES)

        for batch in batches:
            done: list = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + tail
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    length = min(capacity, n - s)
                    win, offset = windows.place(length)
                    held.setdefault(win, []).append(
                        (doc, s, length, zlib.crc32(ids[4 * s : 4 * (s + length)]), n, part, win, offset, 0))
            still = {w for _, w in windows.by_room}
            for w in [w for w in held if w not in still]:
                done += held.pop(w)
            yield emit(done)
        used = {w: capacity - room for room, w in windows.by_room}
        yield emit([(*r[:-1], used[w]) for w, rows in held.items() for r in rows])

    pieces = stage(src.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, "
                                       "win long, offset long, open_used long"), "pack-pieces")
    # open windows: at most `space` a partition, with the sequence they go to and their place there
    left = (pieces.where("open_used > 0").select("part", "win", "open_used").distinct()
            .withColumns({"grp": F.col("part"), "seq_part": F.col("part"), "seq_win": F.col("win"),
                          "shift": F.lit(0).cast("long"), "thin": F.lit(True)}))
    last = left.agg(F.max("grp")).first()[0] or 0
    settled = left.where("false")
    while True:
        last //= merge_group
        merged = left.withColumn("grp", F.expr(f"grp div {merge_group}"))
        merged = stage(merged.groupBy("grp").applyInPandas(_merger(capacity), left.schema), "pack-merge")
        settled, left = settled.unionByName(merged.where("not thin")), merged.where("thin")
        if not last:
            break
    left = settled.unionByName(left)
    seq = left.select(F.col("part").alias("l_part"), F.col("win").alias("l_win"), "seq_part", "seq_win", "shift")
    done = pieces.where("open_used = 0").withColumns(
        {"seq_part": F.col("part"), "seq_win": F.col("win"), "shift": F.lit(0).cast("long")})
    merged = pieces.where("open_used > 0").join(seq, [F.col("part") == F.col("l_part"), F.col("win") == F.col("l_win")])
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq_part", "seq_win", "offset", "shift"]
    return done.select(cols).unionByName(merged.select(cols)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("seq_part * 1099511627776 + seq_win").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))


def _merger(capacity: int):
    """Best-fit decreasing over the sequences of a group; a sequence is moved whole."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pdf.assign(end=pdf["shift"] + pdf["open_used"])
        size = ends.groupby(["seq_part", "seq_win"])["end"].max().sort_index().sort_values(ascending=False, kind="stable")
        rooms: list[tuple[int, int]] = []  # (room, number of the target)
        targets: list[tuple[int, int]] = []
        to: dict[tuple[int, int], tuple[int, int, int]] = {}
        for key, used in zip(size.index, size.to_numpy().tolist(), strict=True):
            k = bisect_left(rooms, (used, -1))
            if k < len(rooms):
                room, t = rooms.pop(k)
            else:
                room, t = capacity, len(targets)
                targets.append(key)
            to[key] = (*targets[t], capacity - room)
            if room > used:
                insort(rooms, (room - used, t))
        moved = [to[k] for k in zip(pdf["seq_part"], pdf["seq_win"], strict=True)]
        full = {t: capacity for t in targets} | {targets[t]: capacity - room for room, t in rooms}
        return pdf.assign(seq_part=[m[0] for m in moved], seq_win=[m[1] for m in moved],
                          shift=pdf["shift"] + [m[2] for m in moved], thin=[2 * full[m[:2]] <= capacity for m in moved])

    return merge
