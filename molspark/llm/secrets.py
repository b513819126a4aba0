"""Secret scans: base patterns, and a lexer that reads assignments in code and configuration."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, small_batches, tidy

# The base patterns and their least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: Parts of a name that make what is assigned to it sensitive, with their weights.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "privatekey": 3.0, "accesskey": 3.0, "auth": 1.5, "bearer": 2.0,
    "key": 1.0, "private": 1.0, "access": 0.7, "api": 0.7, "signature": 1.0, "salt": 1.0, "client": 0.3,
}
#: Literals that stand for a value and are none.
PLACEHOLDERS = {"changeme", "example", "placeholder", "your", "xxxx", "none", "null", "true", "false", "todo", "dummy"}
LEAST_LITERAL, LEAST_SCORE = 8, 4.0

_TOKEN = re.compile(r"""(?P<name>[A-Za-z_$][\w$]*(?:[.-][\w$]+)*)|(?P<quote>\"{3}|'{3}|["'`])|(?P<end>\n)|(?P<tag></?[A-Za-z_][\w.:-]*)"""
                    r"""|(?P<op>:=|=>|\+=|\?=|\|\|=|[=!<>]=+|=|:+/*|->)|(?P<mark>[][(){},;>])""", re.A)
_ASSIGNS = frozenset((":=", "=>", "+=", "?=", "||=", "=", ":"))
_PREFIXES = frozenset("b r u f br rb fr rf".split())
_PREFIX = re.compile(r"(?:[bruf]{1,2}(?=[\"']))?")
_BLANKS = re.compile(r"[ \t]*")
_BARE = re.compile(r"""[^\s"'`,;&(){}\[\]<>|]+""")
_CALLED = re.compile(r"[ \t]?[(\[]")
#: What stands between joined literals: a sign, or blanks alone between two strings.
_PLUS = re.compile(r"[ \t]*(?:\\?\n[ \t]*)?[+.](?![=\w])[ \t]*(?:\\?\n[ \t]*)?|[ \t]+(?=[\"'])")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)*", re.A)
_KEY = re.compile(r"[\w.$ -]+")
_BLOCK = re.compile(r"[|>][+-]?\d?[ \t]*\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
#: A reference or a plain word, not a literal, where no quotes enclose it.
_WORDS = re.compile(r"[A-Za-z_$.-]+")
#: What a known name may look like where it is used.
_KNOWN = re.compile(r"[\w.$-]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Names whose value names the target of the ``value`` that follows.
_NAMERS, _VALUES = frozenset(("name", "key")), frozenset(("value", "val", "default"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base matches: leftmost, non-overlapping per kind, those that are too short dropped."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def name_score(name: str) -> float:
    """The weight of a target name: the sum over its camelCase and snake_case parts and their joined pairs."""
    parts = [p.lower() for p in _PART.findall(name)]
    found = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return sum(SENSITIVE.get(p, 0.0) for p in found)


#: Most letters of a joined value that are counted, and of one that may still be a name.
MOST_LETTERS, MOST_NAME = 1 << 40, 256
_EDGE = max(map(len, PLACEHOLDERS)) - 1


class Literal:
    """A value with what its score needs: how often each letter stands in it, its length, and its edges.

    It is made of spans of the text or of two joined values, so that a join takes the same time however much is joined.
    ``text`` is the value itself, None of a long join; ``sure``: quoted or otherwise no plain word; ``told``: its spans were given out.
    """

    __slots__ = ("text", "spans", "joined", "letters", "size", "head", "tail", "placeholder", "sure", "told")

    def __init__(self, text: str | None, spans: tuple[tuple[int, int], ...], sure: bool = True):
        self.text, self.spans, self.joined, self.sure, self.told = text, spans, (), sure, False
        if text is not None:
            low = text.lower()
            self.letters, self.size, self.head, self.tail = Counter(text), len(text), low[:_EDGE], low[-_EDGE:]
            self.placeholder = any(p in low for p in PLACEHOLDERS)

    def __add__(self, other: Literal) -> Literal:
        out = Literal(None, ())
        out.joined = (self, other)
        size = self.size + other.size
        if size > MOST_LETTERS:  # constants joined to themselves again and again: no letter more or less makes a difference
            out.letters, out.size = self.letters, self.size
        else:
            out.letters, out.size = self.letters + other.letters, size
        if size <= MOST_NAME and self.text is not None and other.text is not None:
            out.text = self.text + other.text
        out.head = self.head if self.size >= _EDGE else (self.head + other.head)[:_EDGE]
        out.tail = other.tail if other.size >= _EDGE else (self.tail + other.tail)[-_EDGE:]
        out.placeholder = self.placeholder or other.placeholder or any(p in self.tail + other.head for p in PLACEHOLDERS)
        return out

    def score(self) -> float:
        """How much it looks like a secret: bits a character, longer and mixed ones more."""
        n = self.size
        if n < LEAST_LITERAL or " " in self.letters or self.placeholder:
            return 0.0
        bits = -sum(c / n * math.log2(c / n) for c in self.letters.values())
        classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "" for c in self.letters})
        return bits * min(1.0, n / 16) * (0.5 + 0.25 * min(classes, 2))

    def tell(self) -> list[tuple[int, int]]:
        """The spans that it is made of, but for those that were told before."""
        out, todo = [], [self]
        while todo:
            part = todo.pop()
            if not part.told:
                part.told = True
                out += part.spans
                todo += part.joined
        return out


def literal_score(value: str) -> float:
    return Literal(value, ()).score()


class Reader:
    """Reads strings and values of one text; remembers where quotes stay open, so that no character is searched twice."""

    def __init__(self, text: str):
        self.text = text
        self.open: dict[str, int] = {}
        self.line = (0, -1)  # the line that was last looked at
        self.called = (0, 0, 0)  # the bare word that was last seen called: where it begins, where it ends without its last signs, and with them

    def line_end(self, at: int) -> int:
        """Where the line that holds ``at`` ends; a line is searched once."""
        if not self.line[0] <= at <= self.line[1]:
            end = self.text.find("\n", at)
            self.line = (at, len(self.text) if end < 0 else end)
        return self.line[1]

    def string(self, quote: str, at: int) -> tuple[Literal, int] | None:
        """The string that ``quote`` begins whose content starts at ``at``, and the place behind it; None if it isn't closed."""
        text = self.text
        if at <= self.open.get(quote, -1):
            return None
        line = self.line_end(at) if quote in ("'", '"') else len(text)
        end = text.find(quote, at, line)
        while end > 0 and _escaped(text, at, end):
            end = text.find(quote, end + 1, line)
        if end < 0:
            self.open[quote] = line
            return None
        return Literal(text[at:end], ((at, end),)), end + len(quote)

    def value(self, at: int, known: dict[str, Literal], block: bool, indent: int) -> tuple[Literal | None, int]:
        """What stands at ``at``: a string, joined strings and constants, a block scalar or a bare word; and the place behind it."""
        text = self.text
        if self.called[0] <= at < self.called[2]:  # in a word that is no value; only a name that ends it may be known
            name = _KNOWN.match(text, at)
            return self._joined(known[name[0]], name.end(), known) if name and name.end() == self.called[1] and name[0] in known else (None, at)
        at = _BLANKS.match(text, at).end()
        start = _PREFIX.match(text, at).end()
        quote = text[start : start + 3] if text[start : start + 3] in ('"""', "'''") else text[start : start + 1]
        if quote and quote in ('"""', "'''", '"', "'", "`"):
            if not (read := self.string(quote, start + len(quote))):
                return None, start + len(quote)
            return self._joined(*read, known)
        if block and (m := _BLOCK.match(text, at)):
            return self._lines(m.end(), indent)
        if not (m := _BARE.match(text, at)):
            return None, at
        stop, end = at + len(m[0].rstrip(".:\\")), m.end()
        called = stop <= at or _CALLED.match(text, end)
        if called:
            self.called = (at, stop, end)
        if (name := _KNOWN.match(text, at)) and name.end() == stop and name[0] in known:
            return self._joined(known[name[0]], stop, known)
        if called:
            return None, at
        if (m := _WORDS.match(text, at)) and m.end() == stop:
            return Literal(m[0], ((at, stop),), False), at
        return Literal(text[at:stop], ((at, stop),)), end

    def _joined(self, first: Literal, at: int, known: dict[str, Literal]) -> tuple[Literal, int]:
        text = self.text
        while m := _PLUS.match(text, at):
            start = m.end()
            if text[start : start + 1] in ("'", '"', "`") and start < len(text):
                if not (read := self.string(text[start], start + 1)):
                    break
                more, at = read
            elif (name := _NAME.match(text, start)) and name[0] in known:
                more, at = known[name[0]], name.end()
            else:
                break
            first = first + more
        return first, at

    def _lines(self, at: int, indent: int) -> tuple[Literal | None, int]:
        """The lines of a block scalar: those indented deeper than its key, without the frame of a key file."""
        values, parts = [], []
        while at < len(self.text):
            m = _LINE.match(self.text, at)
            line = m[2].rstrip()
            if line and len(m[1]) <= indent:
                break
            if line and not line.startswith("-----"):
                values.append(line)
                parts.append((m.start(2), m.start(2) + len(line)))
            at = m.end()
        return (Literal("".join(values), tuple(parts)) if parts else None), at


def _escaped(text: str, first: int, at: int) -> bool:
    """Whether an odd number of backslashes stands before ``at``."""
    n = 0
    while at - n > first and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _target(left: list[tuple[str, str]], annotated: str | None) -> str | None:
    """The name that an operator assigns to, from the tokens before it."""
    if not left:
        return None
    kind, value = left[-1]
    if kind == "]" and len(left) >= 3 and left[-2][0] == "string" and left[-3][0] == "[":
        return left[-2][1]
    if annotated and kind in ("name", "]", ">"):
        return annotated
    return value if kind == "name" or kind == "string" and _KEY.fullmatch(value) else None


def assignments(text: str) -> Iterator[tuple[str, Literal]]:
    """(name, literal) of each pair that source and configuration syntax assigns.

    Reads ``name = "x"``, ``name: x``, ``"name": "x"``, ``name: type = "x"``, ``name := x``, ``name => 'x'``, ``a["name"] = "x"``, ``NAME=x``,
    ``f("name", "x")``, ``name: X`` before ``value: x``, ``<name>x</name>``, ``<add key="name" value="x"/>``; strings in single, double, triple and back
    quotes, with prefixes and escapes; block scalars; joined strings.  A name that was assigned a literal before
    stands for it, in whole or joined, until it is assigned something else.  Time is in proportion to the text.
    """
    reader, known = Reader(text), {}
    left: list[tuple[str, str]] = []
    at, line, indent, named, annotated, element, no_tag = 0, 0, -1, None, None, None, False
    while m := _TOKEN.search(text, at):
        kind, token, at = m.lastgroup, m[0], m.end()
        if kind == "name":
            left.append((kind, token))
        elif kind == "quote":
            before = text[m.start() - 1] if m.start() else " "
            prefix = left[-1][1].lower() if left and left[-1][0] == "name" else ""
            if (before.isalnum() or before == "_") and prefix not in _PREFIXES or not (read := reader.string(token, at)):
                at = m.start() + 1
                continue
            if before.isalnum():
                left.pop()
            literal, at = read
            if len(left) >= 3 and left[-1][0] == "," and left[-2][0] == "string" and left[-3][0] == "(" and _KEY.fullmatch(left[-2][1]):
                yield left[-2][1], literal
            left.append(("string", literal.text))
        elif kind == "end":
            left.clear()
            line, indent, annotated = at, -1, None
        elif kind == "tag":
            left.clear()
            element, annotated = (None if token[1] == "/" else token[1:]), None
        elif kind == "op":
            if token not in _ASSIGNS:
                left.clear()
                continue
            name = _target(left, annotated if token == "=" else None)
            left.clear()
            if name is None:
                continue
            if indent < 0:
                indent = _BLANKS.match(text, line).end() - line
            literal, at = reader.value(at, known, token == ":", indent)
            if literal is None or not literal.sure:
                known.pop(name, None)
                annotated = name if token == ":" else None
            elif token == "+=" and name in known:
                literal = known[name] + literal
            if literal is None:
                continue
            if name.lower() in _NAMERS:
                named = literal.text
            elif named and name.lower() in _VALUES:
                name, named = named, None
            if literal.sure:
                known[name] = literal
                yield name, literal
        else:
            if token == ">" and element:
                name, element = (named or element), None
                stop = -1 if no_tag else text.find("<", at)
                no_tag |= stop < 0
                if stop > at and text.startswith("/", stop + 1) and text[m.start() - 1] != "/":
                    held = text[at:stop]
                    start = at + len(held) - len(held.lstrip())
                    yield name, Literal(held.strip(), ((start, start + len(held.strip())),))
                    named, at = None, stop
            elif token in ",;(){}":
                annotated = None
            left.append((token, token))
        if len(left) > 64:
            del left[:-8]


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that the assignment lexer finds: a sensitive name and a literal that looks secret, where it is defined."""
    if not any(c in text for c in "=:<("):
        return []
    out = set()
    for name, literal in assignments(text):
        if (weight := name_score(name)) >= 1.0 and (score := literal.score()) >= 2.0 and weight + score >= LEAST_SCORE:
            out |= {(start, end, "literal") for start, end in literal.tell() if end > start}
    return sorted(out)


def all_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Base and added spans by start, then by kind as listed; null counts as empty."""
    if not text:
        return []
    return sorted(base_spans(text) + added_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str | None:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, e, _ in spans:
        if s >= end:
            out += [text[at if end < 0 else end : s], mark]
            end = e
        else:
            end = max(end, e)
    return "".join([*out, text[end:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Find secrets in every whole text.

    Returns ``doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans`` and, with ``with_text``,
    ``redacted``: the text with its secrets masked.  Spans are ``kind:start:end`` in code points, end
    exclusive.  One row a row, no shuffle.  A null text counts as empty (its ``redacted`` stays null); no
    secrets give counts 0 and an empty ``spans``.
    """
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_literal", pa.int64()),
              ("base_sha256", pa.string()), ("spans", pa.string())]
    if with_text:
        fields.append(("redacted", pa.string()))

    def row(text: str | None) -> tuple:
        spans = all_spans(text)
        base = [s for s in spans if s[2] != "literal"]
        n = Counter(s[2] for s in spans)
        return (*(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                *([redact(text, spans)] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(row, batch.column(1).to_pylist()), strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))],
                ["doc_id", *(k for k, _ in fields)])

    src = id_and_text(docs, id_col, text_col)
    sql = {pa.int64(): "long", pa.string(): "string"}
    return src.mapInArrow(tidy(run), f"doc_id {src.schema[0].dataType.simpleString()}, " + ", ".join(f"{k} {sql[t]}" for k, t in fields))


def redact_secrets(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs``, all rows and columns, with the secrets in ``text_col`` masked and ``chars_col`` counted anew where masked."""
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            masked = [redact(t, all_spans(t), mark) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(masked, batch.schema.field(at).type)
            if n_at is not None:
                old = columns[n_at].to_pylist()
                columns[n_at] = pa.array([len(m) if m != t else n for t, m, n in zip(texts, masked, old, strict=True)], batch.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)
