"""Language identification by compression with one raw-content dictionary a language."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, tidy

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Texts are compressed in runs of this many bytes, so that the dictionary counts over a whole long text.
RUN = 4096


def letters(text: str | None) -> str:
    """Lower-cased runs of letters, joined and enclosed by blanks; empty if there is no letter."""
    kept = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not kept.replace(" ", "").isalpha():  # numerals beyond the digits, such as halves and Roman ones
        kept = " ".join("".join(c if c.isalpha() else " " for c in kept).split())
    return f" {kept} " if kept else ""


def _shares(sizes: list[int], total: int) -> int:
    """The most bytes a text may give so that all of them give ``total`` at most: short ones give all, the others equal parts."""
    left, among = total, len(sizes)
    for size in sorted(sizes):
        if size * among >= left:
            return left // among
        left, among = left - size, among - 1
    return max(sizes, default=0)


def _dictionary(texts: list[str], most: int) -> bytes:
    """Equal parts of all texts, from a place in each that its hash chooses."""
    raw = [letters(t).encode("utf-8", "surrogatepass") for t in texts]
    part = _shares([len(r) for r in raw], most)
    starts = [zlib.crc32(r) % max(1, len(r) - part + 1) for r in raw]
    return b"".join(r[a : a + part] for r, a in zip(raw, starts, strict=True))


@lru_cache(64)
def _words_of(dictionary: bytes) -> frozenset[bytes]:
    """The words that stand whole in a dictionary."""
    return frozenset(dictionary.split(b" ")[1:-1])


@dataclass(frozen=True)
class CompressionClassifier:
    """``lang -> dictionary`` bytes; at most ``dictionary_bytes`` each."""

    dictionaries: dict[str, bytes]
    margin: float

    def compressors(self) -> list[tuple[str, object]]:
        import zstandard as z

        out = []
        for lang, raw in sorted(self.dictionaries.items()):
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(
                6, dict_size=len(raw), source_size=RUN, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            out.append((lang, z.ZstdCompressor(dict_data=d, compression_params=params)))
        return out

    def predict(self, text: str | None, compressors: list) -> tuple[str, float, bool]:
        """(language, score, rejected): score is the relative gap between the two smallest sizes."""
        kept = letters(text)
        if not kept or not compressors:
            return UNKNOWN, 0.0, True
        raw = kept.encode("utf-8", "surrogatepass")
        runs = [raw[i : i + RUN] for i in range(0, len(raw), RUN)]
        sizes = [(sum(len(c.compress(r)) for r in runs), lang) for lang, c in compressors]
        sizes.sort()
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        if sizes[0][0] == sizes[1][0]:  # too short to tell by size: count the words that a dictionary holds
            some = Counter(raw.split())
            tied = [lang for n, lang in sizes if n == sizes[0][0]]
            held = {lang: _words_of(self.dictionaries[lang]) for lang in tied}
            best = max(tied, key=lambda lang: (sum(n for w, n in some.items() if w in held[lang]), lang))
            return best, 0.0, True
        score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], score, score < self.margin


def fit_languages(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = 98_304,
                  sample_rows: int = 400, sample_bytes: tuple[int, int] = (200, 8_000), margin: float = 0.01) -> CompressionClassifier:
    """Fit on a bounded sample: for each language ``sample_rows`` distinct texts, chosen by hash.

    The sample is drawn by a hash threshold from each language's number of distinct texts first (copies of a text count
    once, so they hide no language), so that no language's rows meet in one task.  Of a text above the second of ``sample_bytes`` a slice of that many characters, at a place that its hash chooses,
    is taken.  Texts below the first are used only where a language has no others.  A dictionary of
    ``dictionary_bytes`` takes equal parts of all its language's texts.  Rows without text, letters
    or language are ignored; without any, nothing is learned and every prediction is ``und``.
    """
    lo, hi = sample_bytes
    rows = (labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
            .where("lang is not null and text is not null and text != ''")
            .withColumns({"h": F.xxhash64("text"), "long": F.octet_length("text") >= lo}))
    # of distinct texts, however many copies there are; four times the wanted ones pass the threshold, so a few percent of error leave enough
    counts = rows.groupBy("lang", "long").agg(F.approx_count_distinct("h", 0.05).alias("c"))
    wanted = rows.join(F.broadcast(counts), ["lang", "long"]).where(
        F.expr(f"pmod(h, 1000000007) < 1000000007 * least(1.0D, {4 * sample_rows}.0D / c)"))
    distinct = wanted.dropDuplicates(["lang", "long", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("long").desc(), "h"))
    sample = distinct.withColumn("k", rank).where(F.col("k") <= sample_rows).select("lang", "k", F.substring(
        "text", F.expr(f"1 + cast(pmod(h, greatest(1, length(text) - {hi} + 1)) as int)"), F.lit(hi)).alias("text")).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample:
        texts.setdefault(r.lang, []).append((r.k, r.text))
    out = {}
    for lang, found in texts.items():
        if raw := _dictionary([t for _, t in sorted(found)], dictionary_bytes):
            out[lang] = raw
    return CompressionClassifier(out, margin)


def identify_languages(docs: DataFrame, model: CompressionClassifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classify every whole text by the dictionary with which it compresses best.

    Returns ``doc_id, lang_pred, score, rejected``.  ``score`` (0 to 1) is the gap between the smallest and the
    next size, relative to the latter; ``rejected`` marks one below the model's margin.  A null text, or
    one without a letter, is ``und`` with score 0.  A tie in size goes to the dictionary that holds more of
    the text's words.  One row a row, no shuffle; the model is bounded by its dictionaries' size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            found = [model.predict(t, compressors) for t in batch.column(1).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(tidy(run), f"doc_id {src.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
