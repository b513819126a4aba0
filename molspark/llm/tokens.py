"""Token ids of whole texts by a byte-level BPE tokenizers file, each distinct chunk of text encoded once."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where Latin-1 prints it, else the next from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b) if prints[b] else chr(256 + b - sum(prints[:b])) for b in range(256)]


class ByteEncoder:
    """Ids of texts, each distinct piece encoded once.

    The tokenizer splits a text by its pattern and encodes each piece on its own, so the ids of a text are those of its pieces
    joined.  Texts of Latin letters are split here, others by the tokenizer; pieces are encoded by the tokenizer's model.
    The pattern never joins a blank to what stands before it, so texts may also be cut before single blanks (``chunk_ids``).
    With ``plain`` the strings of special tokens are text like any other; else a text that holds one goes to the tokenizer whole.
    """

    def __init__(self, path: str, plain: bool = False, most_pieces: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of an id in a file: 2 where the vocabulary is that small.
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.specials = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer
        #: Whether texts may be cut; a file with other steps before its model gets every text whole.
        self.cuts = isinstance(cut, pre_tokenizers.ByteLevel) and not cut.add_prefix_space and cut.use_regex and self.tokenizer.normalizer is None
        self.white = self._white_space() if self.cuts else ""
        #: Ids of pieces.  Of those met since half of ``most_pieces`` were known, and of that half, none is encoded again.
        self.most = most_pieces // 2
        self.piece, self.old_piece = {}, {}
        if not self.cuts:
            return
        some = [chr(c) for c in range(0x21, 0x250)]
        letter, number = ("".join(c for c in some if unicodedata.category(c)[0] == k) for k in "LN")
        white = re.escape(self.white)
        # Fixed value: the pattern of the tokenizer's own splitter, letters and numbers those of plain text; the most frequent case stands first.
        self.split = re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+").findall
        self.plain = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*").fullmatch
        self.letters = "".join(byte_letters())
        #: The model alone, and the id of a NUL.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(self.letters[0], "isolated")
        self.nul = vocabulary[self.letters[0]]

    def _white_space(self) -> str:
        """What the tokenizer's pattern takes for white space: of two such characters before a letter the first stands alone."""
        cut = self.tokenizer.pre_tokenizer
        some = [c for c in map(chr, range(0x3001)) if c.isspace() or unicodedata.category(c)[0] == "Z" or unicodedata.category(c) == "Cc"]
        return "".join(c for c in some if len(cut.pre_tokenize_str(f"a{c}{c}a")) == (3 if c == " " else 4))

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def ids(self, text: str) -> np.ndarray:
        return self._ids(self.tokenizer, text)

    def whole(self, chunk: str) -> bool:
        """Whether a text may be cut before and after this chunk."""
        return bool(chunk) and chunk[0] not in self.white and chunk[-1] not in self.white

    def _learn(self, pieces: set[str]) -> None:
        """Have the ids of these pieces of plain text at hand."""
        if len(self.piece) > self.most:
            self.old_piece, self.piece = self.piece, {}
        new = pieces - self.piece.keys()
        self.piece.update({p: self.old_piece[p] for p in new & self.old_piece.keys()})
        new = list(new - self.old_piece.keys())
        if new:
            # all new pieces as one text of the letters that stand for bytes; no piece holds a NUL, which parts them
            ids = self._ids(self.model, "\0".join(new).encode().decode("latin-1").translate(self.letters))
            raw, at = ids.tobytes(), (np.flatnonzero(ids == self.nul) * self.width).tolist()
            self.piece.update(zip(new, [raw[a:b] for a, b in zip([0, *[x + self.width for x in at]], [*at, len(raw)], strict=True)], strict=True))

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of " " + chunk for each chunk, all of them ``whole``."""
        if not self.plain("".join(chunks)):
            odd = [not self.plain(c) for c in chunks]
            plain = iter(self.chunk_ids([c for c, o in zip(chunks, odd, strict=True) if not o]))
            return [self.ids(" " + c).tobytes() if o else next(plain) for c, o in zip(chunks, odd, strict=True)]
        pieces = self.split("".join([" " + c for c in chunks]))
        self._learn(set(pieces))
        ids = list(map(self.piece.__getitem__, pieces))
        first = [i for i, p in enumerate(pieces) if p[0] == " "]
        if len(first) != len(chunks):
            raise ValueError("the pieces of a text don't begin at its blanks")
        return [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(first, [*first[1:], len(ids)])]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of ``width`` bytes each, of every text (null: none)."""
        split = [self.split(t) if t and self.cuts and self.plain(t) and not any(s in t for s in self.specials) else None for t in texts]
        self._learn(set().union(*filter(None, split)))
        get = self.piece.__getitem__
        return [b"".join(map(get, pieces)) if pieces else self.ids(text).tobytes() if text else b"" for text, pieces in zip(texts, split, strict=True)]


@cache
def byte_encoder(path: str, plain: bool = False) -> ByteEncoder:
    """One encoder a Python worker, so that what it remembers serves all its tasks."""
    return ByteEncoder(path, plain)
