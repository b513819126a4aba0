"""Column functions over nucleotide and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements, upper and lower case; what isn't listed stands for itself.
COMPLEMENT_FROM = "ACGTMKRYVBacgtvb"
COMPLEMENT_TO = "TGCAKMYRBVtgcabv"
#: Longer strings get no variants.
FUZZY_LONGEST = 200


def reverse_complement(seq: Column | str) -> Column:
    """Reverse complement over the IUPAC alphabet; unknown characters stay."""
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def reverse_complement_text(seq: str) -> str:
    return seq.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]


def fuzzy_pattern(text: str, wildcard: str = ".{0,1}", include_original: bool = True, sep: str = "|") -> str:
    """Alternatives for ``text`` with any one character replaced by ``wildcard``; the text itself comes first."""
    variants = [text[:i] + wildcard + text[i + 1 :] for i in range(len(text))] if len(text) <= FUZZY_LONGEST else []
    return sep.join(([text] if include_original or not text else []) + variants)


def fuzzy_regex(text: str, wildcard: str = ".{0,1}") -> str:
    """The same matches as ``fuzzy_pattern``, tried in the same order, for an engine that backtracks.

    Variants share their beginning, so one that can't match is left at its first wrong letter: where ``fuzzy_pattern`` tries every
    variant at every place, this tries about two.
    """
    if not text or len(text) > FUZZY_LONGEST:
        return text
    nested = wildcard
    for i in range(len(text) - 2, -1, -1):
        nested = f"{wildcard}{text[i + 1:]}|{text[i]}(?:{nested})"
    return f"{text}|{nested}"


def extract_or_null(seq: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches (an empty match stays empty)."""
    return F.when(F.rlike(seq, F.lit(pattern)), F.regexp_extract(seq, pattern, group))


def replace_first(seq: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only."""
    return F.regexp_replace(seq, f"^(?s)(.*?)(?:{pattern})(.*)$", f"$1{replacement}$2")


def half_guard(seq: Column, text: str) -> Column:
    """True where ``seq`` may hold ``text`` with one error: one half of it must be intact."""
    half = len(text) // 2
    return seq.contains(text[:half]) | seq.contains(text[half:])


def has_fuzzy(seq: Column, text: str, wildcard: str = ".{0,1}") -> Column:
    """Whether a fuzzy hit of ``text`` is in ``seq``: most rows are decided by a plain search."""
    return seq.contains(text) | half_guard(seq, text) & seq.rlike(fuzzy_regex(text, wildcard))


def _count(seq: Column, text: str) -> Column:
    """How often ``text`` stands in ``seq``, without overlaps."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(text)))) / len(text)).cast("int")


def _overlaps(seq: Column, text: str) -> Column:
    """Whether ``text`` stands in ``seq`` twice with an overlap."""
    out = F.lit(False)
    for k in range(1, len(text)):
        if text[:k] == text[-k:]:
            out = out | seq.contains(text + text[k:])
    return out


def sanitize(seq: Column, text: str, wildcard: str = ".{0,1}") -> Column:
    """Every fuzzy hit of ``text`` replaced by ``text``; rows without an inexact hit skip the pattern.

    An error leaves one half of ``text`` intact.  With at most one letter for another, a half that stands nowhere but in whole hits gives no inexact one.
    ``seq`` stands in the expression once, however many of these are nested, so plans stay small.
    """
    half = len(text) // 2

    def one(s: Column) -> Column:
        if wildcard == ".{0,1}" and half:
            whole = _count(s, text)
            guard = (_count(s, text[:half]) > whole) | (_count(s, text[half:]) > whole) | _overlaps(s, text[:half]) | _overlaps(s, text[half:])
        else:
            guard = half_guard(s, text)
        return F.when(guard, F.regexp_replace(s, fuzzy_regex(text, wildcard), text)).otherwise(s)

    return F.transform(F.array(seq), one)[0]


def spacer_correction(seq: Column | str) -> Column:
    """Give a spacer that starts with GT or GGT and stands before the scaffold the start GGT; else unchanged."""
    c = F.col(seq) if isinstance(seq, str) else seq
    pattern = "(G{1,2}T)(.*?)(GGGTTAGA)"
    return F.when(c.rlike(pattern), F.concat(F.lit("GGT"), F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3))).otherwise(c)


def dna_scramble(seed: Column, seq: Column) -> Column:
    """A permutation of the letters that depends on ``seed`` alone: letters in the order of md5(seed, position)."""
    keyed = F.transform(F.split(seq, ""), lambda c, i: F.struct(F.md5(F.concat(seed, (i + 1).cast("string"))).alias("k"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["c"]), "")


def scramble_text(seed: str, seq: str) -> str:
    """The same permutation on the driver, for patterns."""
    import hashlib

    order = sorted(range(len(seq)), key=lambda i: (hashlib.md5(f"{seed}{i + 1}".encode()).hexdigest(), i))
    return "".join(seq[i] for i in order)


def low_quality_bases(qual: Column, min_qual: str = "@") -> Column:
    """Bases whose quality character is ``min_qual`` or below."""
    return F.size(F.filter(F.split(qual, ""), lambda c: (F.length(c) > 0) & (F.ascii(c) <= ord(min_qual))))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 (excluded) that depends on the seed and the key alone, the same in every engine: the first 32 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_order(seed: int, *keys: Column) -> Column:
    """A text by which rows stand in a random order that depends on the seed and the keys alone, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
