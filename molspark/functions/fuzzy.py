"""Fuzzy hits of a text in Python strings, for functions that run inside tasks on Arrow arrays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from .sequence import FUZZY_LONGEST, fuzzy_regex

#: What ``.`` stands for in a pattern of Spark's: no line terminator.
LETTER = "[^\n\r\x85\u2028\u2029]"
#: ``$`` in a pattern of Spark's: the end, or what stands before a last line terminator.
END = "(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\\Z)"


def compiled(pattern: str) -> re.Pattern:
    """A pattern of Spark's without escaped dots or dollars."""
    return re.compile(pattern.replace(".", LETTER).replace("$", END))


class Fuzzy:
    """The hits of ``fuzzy_regex(text)`` from the left, as its pattern finds them.

    An error leaves one half of the text intact, so the pattern is tried only where a half stands: time goes with the letters, not with the variants.
    """

    def __init__(self, text: str):
        self.pattern = compiled(fuzzy_regex(text))
        self.half = len(text) // 2 if text.isalnum() and len(text) <= FUZZY_LONGEST else 0
        self.first, self.second = text[: self.half], text[self.half :]

    def starts(self, s: str) -> Iterable[int]:
        """Where a hit may begin, in order."""
        out = set()
        at = s.find(self.first)
        while at >= 0:
            out.add(at)
            at = s.find(self.first, at + 1)
        at = s.find(self.second)
        while at >= 0:
            out.add(at - self.half)
            out.add(at - self.half + 1)
            at = s.find(self.second, at + 1)
        out.discard(-self.half)
        return sorted(x for x in out if x >= 0)

    def spans(self, s: str) -> Iterator[tuple[int, int]]:
        if not self.half:
            yield from (m.span() for m in self.pattern.finditer(s))
            return
        end = 0
        for at in self.starts(s):
            if at >= end and (m := self.pattern.match(s, at)):
                end = m.end()
                yield at, end

    def replaced(self, s: str, token: str) -> str:
        """All hits by ``token``."""
        out, end = [], 0
        for a, b in self.spans(s):
            out += (s[end:a], token)
            end = b
        return "".join((*out, s[end:])) if end else s

    def cut_to(self, s: str, token: str, last: bool) -> str:
        """Each hit, or the ``last`` one of a line, and all that stands before it on its line by ``token``: the patterns ``.*?(text)`` and ``.*(text)``."""
        if last:
            where = self.starts(s) if self.half else range(len(s) + 1)
            found = [m.span() for at in where if (m := self.pattern.match(s, at))]
        else:
            found = list(self.spans(s))
        out, end = [], 0
        for k, (a, b) in enumerate(found):
            breaks = [m.end() for m in _BREAK.finditer(s, end, a)] if not s.isascii() or "\n" in s or "\r" in s else []
            if last and k + 1 < len(found) and not _BREAK.search(s, b, found[k + 1][0]):
                continue
            out += (s[end : breaks[-1]] if breaks else "", token)
            end = b
        return "".join((*out, s[end:])) if out else s


_BREAK = re.compile("[\n\r\x85\u2028\u2029]")


def each_text(texts: pa.Array, f: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``f`` of every text, null of null; each distinct text of the array once."""
    coded = texts.dictionary_encode()
    return pa.array([f(s) for s in coded.dictionary.to_pylist()], kind).take(coded.indices)
