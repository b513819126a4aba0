"""Spelling variants: words of a corpus one edit apart, found by a bit-sliced position index of the vocabulary."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, join_unique, stage, tidy

#: Words of a bucket before it is split; a bucket that differs in one letter's place can't be split, and has some 60**2 words at most.
BUCKET_WORDS = 8192
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 400_000


def _letters() -> bytes:
    """Latin-1: A-Z lower-cased, what is no letter a blank."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 192 <= b else 32 for b in range(256))


_LETTERS = _letters()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def count_words(docs: DataFrame, *, least_length: int = 7, typo_every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: how often each run of letters stands in all texts, A-Z lower-cased, of at least ``least_length`` code points.

    Letters are A-Z, a-z and U+00C0 to U+00FF.  Where ``typo_every`` divides h, the CRC-32 of ``<id>:<run>``, the run loses its
    code point h % length first (0: no run does).  Counts are summed in the task before they are shuffled.
    """
    src = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        crc32 = zlib.crc32

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([_utf8(w).decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # a character beyond U+00FF becomes a question mark, no letter
                runs = (text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split(b" ")
                begin = crc32(f"{'' if doc is None else doc}:".encode())
                for r in runs:
                    if len(r) >= least_length:
                        h = crc32(_utf8(r), begin) if typo_every else 1
                        if typo_every and not h % typo_every:
                            at = h % len(r)
                            r = r[:at] + r[at + 1 :]
                            if len(r) < least_length:
                                continue
                        counts[r] = counts.get(r, 0) + 1
            if len(counts) > HELD_WORDS:
                yield emit()
        yield emit()

    return src.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Per (position, letter) the set of words with that letter there, as the bits of one integer; longer words have lower bits."""

    def __init__(self, words: list[str]):
        self.words = words
        self.at: dict[tuple[int, str], int] = {}
        self.of_length: dict[int, int] = {}
        held: dict[tuple[int, str], bytearray] = {}
        order = sorted(range(len(words)), key=lambda k: (-len(words[k]), words[k]))
        self.word_at = order
        for bit, k in enumerate(order):
            byte, one = bit >> 3, 1 << (bit & 7)
            for slot in (*enumerate(words[k]), (-1, len(words[k]))):
                bits = held.setdefault(slot, bytearray())
                if len(bits) <= byte:
                    bits.extend(bytes(byte + 1 - len(bits)))
                bits[byte] |= one
        for (position, letter), bits in held.items():
            if position < 0:
                self.of_length[letter] = int.from_bytes(bits, "little")
            else:
                self.at[position, letter] = int.from_bytes(bits, "little")

    def near(self, word: str, among: int) -> int:
        """Words of ``among`` that one inserted, deleted or replaced letter tells from ``word``.

        After each letter: the words that agree so far, and those with one error so far: aligned (replaced), one letter
        ahead (inserted) or behind (deleted).  All words take each step at once.
        """
        at, none = self.at.get, 0
        exact, replaced, ahead, behind, lost = among, none, none, none, none
        for i, letter in enumerate(word):
            here, after = at((i, letter), none), at((i + 1, letter), none)
            lost = exact  # this letter of the word isn't there
            behind = behind & at((i - 1, letter), none) | lost if i else lost
            ahead = (ahead | exact) & after
            replaced = replaced & here | exact & ~here
            exact &= here
            if not (exact or replaced or ahead or behind):
                return none
        n, length = len(word), self.of_length.get
        return replaced & length(n, none) | (ahead | exact) & length(n + 1, none) | behind & length(n - 1, none)

    def members(self, bits: int) -> Iterator[int]:
        """Numbers of the words in a set."""
        while bits:
            low = bits & -bits
            yield self.word_at[low.bit_length() - 1]
            bits ^= low


def _common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _key() -> Column:
    """Words of a bucket: the shorter word's length, and the same letters before and after the part with the edit."""
    return F.xxhash64("m", "a", "z", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, z)"))


def bucket_words(words: DataFrame, least_length: int) -> DataFrame:
    """Deal words so that two words one edit apart meet in exactly one bucket: ``word, n, m, a, z, b, key``.

    ``m`` is the length of the shorter of two; a word is in the buckets of its own length and of one less.  Of two words one edit
    apart, the first ``a`` letters agree or the last ``z`` do: a bucket of more than BUCKET_WORDS is split by the halves of the
    part that may still differ, each into two, and so on until the part is one letter.  Two words that agree in the front half belong to
    that bucket alone: elsewhere they agree in fewer than ``b`` letters.
    """
    rows = words.select("word", "n", F.explode(F.expr("array(length(word), length(word) - 1)")).alias("m")).where(F.col("m") >= least_length).withColumns(
        {"a": F.lit(0), "z": F.lit(0), "b": F.lit(1 << 30)}).withColumn("key", _key())
    done = None
    while True:
        rows = stage(rows, "spelling-buckets")
        sizes = stage(rows.where("m - a - z > 1").groupBy("key").agg(F.count("*").alias("size")).where(f"size > {BUCKET_WORDS}"), "spelling-large")
        large = sizes.count()
        total = rows.count() if large else 0
        if not large:
            return rows if done is None else done.unionByName(rows)
        # keys of more than BUCKET_WORDS rows: fewer than total / BUCKET_WORDS; the hot ones stay where they stand
        met = join_unique(rows, sizes, "key", "size", total, "left")
        small = met.where("size is null or m - a - z <= 1").drop("size")
        halves = met.where("size is not null and m - a - z > 1").withColumn("half", F.expr("(m - a - z) div 2")).withColumn(
            "to", F.explode(F.expr("array(struct(a + half as a, z, b), struct(a, m - a - half as z, least(b, a + half) as b))"))).select("word", "n", "m", "to.*").withColumn("key", _key())
        done = small if done is None else done.unionByName(small)
        rows = halves


def near_words(words: DataFrame, least_length: int) -> DataFrame:
    """``word, n_near, form, form_n``: of each word with near ones how many, and the most frequent one (ties: smallest in code-point order)."""
    rows = bucket_words(words, least_length)
    counts = stage(rows.groupBy("key").agg(F.count("*").alias("size")), "spelling-sizes")
    rows = rows.join(counts.where("size > 1"), "key").drop("size")
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0] and len(held) >= BUCKET_WORDS:
                    yield _near(held)
                    held = []
                held.append(row)
        if held:
            yield _near(held)

    found = dealt.select("key", "word", "n", "m", "b").mapInArrow(tidy(run), "word string, n_near long, form string, form_n long")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))  # strings sort by code points
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", "best.form_n")


def _near(rows: list[tuple]) -> pa.RecordBatch:
    """The near words of each word within its bucket, for whole buckets that stand one after the other."""
    index = PositionIndex([r[1] for r in rows])
    bit = {k: b for b, k in enumerate(index.word_at)}
    buckets: dict[int, int] = {}
    for k, r in enumerate(rows):
        buckets[r[0]] = buckets.get(r[0], 0) | 1 << bit[k]
    out: list[tuple] = []
    for key, word, _, m, b in rows:
        n_near, best = 0, None
        near = index.near(word, buckets[key])
        if len(word) > m:  # two words of m + 1 letters meet in the bucket of m + 1
            near &= index.of_length.get(m, 0)
        for k in index.members(near):
            _, other, n, _, _ = rows[k]
            if b > len(word) or _common_start(word, other) < b:
                n_near += 1
                if best is None or n > best[1] or n == best[1] and other < best[0]:
                    best = (other, n)
        if n_near:
            out.append((word, n_near, *best))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], names=["word", "n_near", "form", "form_n"])


def group_spellings(docs: DataFrame, *, least_length: int = 7, least_count: int = 2, times: int = 10, typo_every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the words of all texts by spelling: ``word, form, root, n, n_near, form_n``.

    Words are those of ``count_words`` with ``n`` of at least ``least_count``.  Two are near if one inserted, deleted or replaced code
    point tells them apart.  A word's form is its near word of largest n (ties: smallest), if that n is at least ``times`` its own; ``root`` is where
    following forms ends, the word itself if it has none.  Null and empty texts have no words; a null id counts as an empty one; repeated rows count again.
    No words give no rows.  Other columns aren't read.
    """
    words = stage(count_words(docs, least_length=least_length, typo_every=typo_every, id_col=id_col, text_col=text_col).where(F.col("n") >= least_count), "spelling-words")
    near = words.join(near_words(words, least_length), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n")
    holds = F.col("form_n") >= times * F.col("n")
    out = stage(near.withColumns({"form": F.when(holds, F.col("form")), "form_n": F.when(holds, F.col("form_n"))}), "spelling-near")
    return out.join(_roots(out), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form.  Each round doubles the steps; n rises at every step, so there are few."""
    to = stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        # a frequent root is met by a broadcast of the few that a HOT-th of the words have
        often = stage(to.groupBy("root").agg(F.count("*").alias("size")).join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"), "spelling-next")
        total = to.count()
        if often.isEmpty():
            return to
        stepped = join_unique(to, often, "root", "size", total, "left")
        to = stage(stepped.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
