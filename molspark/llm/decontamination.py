"""Benchmark decontamination by a positional inverted index of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, apart, block_ids, free, id_and_text, small_batches, stage, sub_batches, tidy, tidy_group

WINDOW = 13
#: Benchmark windows searched at once; a larger benchmark is searched in slices, so what is collected and broadcast stays bounded.
SLICE_WINDOWS = 200_000
#: How far a word may stand from its place in a near window.
SLOP = 3
#: Positions of at least this many bytes are compressed; most lists hold one or two.
PACKED = 32
#: Window starts checked at once in a block.
STARTS_AT_ONCE = 4_000_000

_INDEX = pa.schema([("block", pa.int64()), ("term", pa.int64()), ("n", pa.int64()), ("positions", pa.binary()),
                    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
INDEX_SCHEMA = "block long, term long, n long, positions binary, doc_ids array<long>, starts array<long>"
#: ``term`` of the row that lists a block's documents.
DIRECTORY = 0


def positional_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW + SLOP) -> DataFrame:
    """Positional postings of every word of whole texts, by blocks of documents.

    A block is a run of documents of about 8 MB (or one longer document); its words are numbered through,
    with ``gap`` free numbers between documents so that no window crosses them.  A row holds the word
    numbers of one term in one block, delta-coded and, if long, compressed; the row of term 0 lists the block's
    documents and where each starts.  Returned as a stored table, so that it is built once however often it
    is searched.  Null and empty texts have no words but stand in the directory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, pack = block_ids(), zstandard.ZstdCompressor(1)
        hashes = WordHashes()
        for batch in batches:
            for part in sub_batches(batch, 1):
                numbers, starts, at = [], [], 0
                for text in part.column(1).to_pylist():
                    numbers.append(hashes.of(text))
                    starts.append(at)
                    at += len(numbers[-1]) + gap
                starts.append(at)
                flat = np.concatenate(numbers).view(np.int64)
                where = np.arange(len(flat)) + np.repeat(np.arange(len(numbers)) * gap, [len(x) for x in numbers])
                order = np.argsort(flat, kind="stable")
                term, where = flat[order], where[order]
                cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.array([], int)
                ends = np.r_[cuts[1:], len(term)]
                delta = np.diff(where, prepend=0)
                delta[cuts] = where[cuts]
                raw = delta.astype("<u4").tobytes()
                lists = [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=False)]
                lists = [pack.compress(x) if len(x) >= PACKED else x for x in lists]
                n, block = len(lists), next(blocks)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + 1, block)), pa.array(np.r_[DIRECTORY, term[cuts]]),
                    pa.array(np.r_[at, ends[:n] - cuts]), pa.array([b"", *lists], pa.binary()),
                    pa.array([part.column(0).to_pylist(), *[None] * n], pa.list_(pa.int64())),
                    pa.array([starts, *[None] * n], pa.list_(pa.int64()))], schema=_INDEX)

    src = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return stage(src.mapInArrow(tidy(run), INDEX_SCHEMA), "positional-index")


@dataclass(frozen=True)
class Windows:
    """Windows of benchmark items: term hashes (0 behind the end), lengths, and offsets from the rarest term up."""

    items: np.ndarray  # item number of each window
    names: list[str]
    terms: np.ndarray  # windows x WINDOW
    lengths: np.ndarray
    order: np.ndarray


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, *, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item, terms``: the distinct windows of ``size`` consecutive words of each item; an item of fewer words, but not none, is one window."""
    items = small_batches(benchmark).select(F.coalesce(F.col(f"`{item_id_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashes.of(text).view(np.int64)
                for first in range(0, len(h), 10_000):  # an item of any length is handed on in parts
                    part = h[first : first + 10_000 + size - 1]
                    if n := min(size, len(h)) if len(part) >= min(size, len(h)) else 0:
                        rows = np.lib.stride_tricks.sliding_window_view(part, n)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(list(rows), pa.list_(pa.int64()))], ["item", "terms"])

    return items.mapInArrow(tidy(run), "item string, terms array<long>").distinct()


def windows_of(rows: list[tuple[str, list[int]]], frequency: dict[int, int], size: int) -> Windows:
    """Windows with the offsets of their terms from the rarest in the corpus up; ties by place."""
    names = sorted({name for name, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    lengths = np.array([len(t) for _, t in rows], np.int64)
    terms = np.zeros((len(rows), size), np.int64)
    for i, (_, t) in enumerate(rows):
        terms[i, : len(t)] = t
    count = np.array([frequency.get(t, 0) for t in terms.ravel().tolist()], np.int64).reshape(terms.shape)
    count[np.arange(size) >= lengths[:, None]] = np.iinfo(np.int64).max
    return Windows(np.array([number[name] for name, _ in rows], np.int64), names, terms, lengths, np.argsort(count, axis=1, kind="stable"))


_HITS = "block long, ord int, doc_id long, n_words long, spans array<int>, items array<string>, near_items array<string>"


def search_block(pdf: pd.DataFrame, windows: Windows, near_terms: int, slop: int) -> pd.DataFrame:
    """Phrase and proximity matches in one block of the index, a row a document."""
    directory = pdf[pdf["term"] == DIRECTORY].iloc[0]
    starts, length = np.asarray(directory["starts"], np.int64), int(directory["n"])
    n_docs, size = len(starts) - 1, windows.terms.shape[1]
    n_words = np.diff(starts) - (size + slop)  # the gap between documents
    pad = size + slop
    sequence = np.zeros(length + 2 * pad, np.int64)  # the term at each word number, moved by pad
    lists: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for term, n, coded in zip(pdf["term"].tolist(), pdf["n"].tolist(), pdf["positions"], strict=True):
        if term != DIRECTORY:
            at = np.cumsum(np.frombuffer(unpack.decompress(coded) if 4 * n >= PACKED else coded, "<u4"), dtype=np.int64)
            lists[term] = at
            sequence[at + pad] = term
    rarest = np.take_along_axis(windows.terms, windows.order[:, :1], 1)[:, 0] if len(windows.terms) else np.array([], np.int64)
    many = np.array([len(lists.get(t, ())) for t in rarest.tolist()], np.int64)
    live = np.flatnonzero(many)
    exact: list[tuple[np.ndarray, np.ndarray]] = []
    near: list[tuple[np.ndarray, np.ndarray]] = []
    group = (np.cumsum(many[live]) // STARTS_AT_ONCE) if len(live) else live
    for g in np.unique(group):
        part = live[group == g]
        win = np.repeat(part, many[part])
        first = np.concatenate([lists[t] for t in rarest[part].tolist()]) - windows.order[win, 0] + pad
        ok = (first >= 0) & (first < length + pad)
        win, first = win[ok], first[ok]
        w, s = win, first
        for k in range(1, size):  # the next rarest list, moved by its offset, cuts what is left
            off = windows.order[w, k]
            keep = (k >= windows.lengths[w]) | (sequence[s + off] == windows.terms[w, off])
            w, s = w[keep], s[keep]
        exact.append((w, s - pad))
        w, s = win, first
        for k in range(1, near_terms):
            off = windows.order[w, k]
            found = k >= windows.lengths[w]
            for move in range(-slop, slop + 1):
                found |= sequence[np.clip(s + off + move, 0, len(sequence) - 1)] == windows.terms[w, off]
            w, s = w[found], s[found]
        # a place is in the document of its rarest term
        near.append((w, s - pad + windows.order[w, 0]))
    w, s = (np.concatenate(x) for x in zip(*exact, strict=True)) if exact else (live, live)
    marks = np.zeros(length + size + 1, np.int64)
    np.add.at(marks, s, 1)
    np.add.at(marks, s + windows.lengths[w], -1)
    edges = np.flatnonzero(np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0))
    begins, stops = edges[::2], edges[1::2]
    span_doc = np.searchsorted(starts, begins, "right") - 1
    spans: list[list[int]] = [[] for _ in range(n_docs)]
    for d, a, b in zip(span_doc.tolist(), begins.tolist(), stops.tolist(), strict=True):
        spans[d] += [a - int(starts[d]), b - int(starts[d])]

    def named(w: np.ndarray, place: np.ndarray) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in range(n_docs)]
        doc = np.searchsorted(starts, place, "right") - 1
        for key in np.unique(doc * max(1, len(windows.names)) + windows.items[w]).tolist():
            out[key // len(windows.names)].append(windows.names[key % len(windows.names)])
        return [sorted(set(x)) for x in out]

    wn, sn = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (live, live)
    return pd.DataFrame({"block": int(directory["block"]), "ord": np.arange(n_docs, dtype=np.int32),
                         "doc_id": pd.array([None if d is None or d != d else int(d) for d in directory["doc_ids"]], "Int64"), "n_words": n_words,
                         "spans": spans, "items": named(w, s), "near_items": named(wn, sn)})


def _searcher(windows: Windows, near_terms: int, slop: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return search_block(pdf, windows, near_terms, slop)

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       near_terms: int = 4, slop: int = SLOP) -> DataFrame:
    """Phrase and proximity matches of benchmark windows in whole documents.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.
    The postings of all words of the documents are stored once.  Windows, made where the items are, are searched in slices of about
    SLICE_WINDOWS by hash, so neither a large benchmark nor a long item is collected whole.  Each window starts from the list of its rarest word in the
    corpus; the other lists, moved by their offsets, cut it down, the next rarest first.  What is left are
    the exact phrases.  A window is near where its ``near_terms`` rarest words (ties by place) all stand within ``slop``
    words of their places relative to the rarest, in one document.

    Returns ``doc_id, n_words, n_hit, spans, items, near_items``, a row a document row: hit words and their
    merged word spans (start, end, start, end, ...), and the item ids, as sorted strings, with a phrase or a
    near window in it.  A null or empty text has no words and no hits; items without words never match; an
    empty benchmark gives no hits.  Repeated item ids count once, a null one as ``null``.  Document ids are integers (others become null); a null id stays null.
    """
    windows = stage(benchmark_windows(benchmark, window, item_id_col=item_id_col, item_text_col=item_text_col), "benchmark-windows")
    index = positional_index(docs, id_col=id_col, text_col=text_col, gap=window + slop)
    n_slices = max(1, -(-windows.count() // SLICE_WINDOWS))
    hits = []
    for k in range(n_slices):
        part = windows if n_slices == 1 else windows.where(F.pmod(F.xxhash64("item", "terms"), F.lit(n_slices)) == k)
        rows = sorted((r.item, r.terms) for r in part.collect())
        terms = docs.sparkSession.createDataFrame([(t,) for t in sorted({DIRECTORY, *(t for _, ts in rows for t in ts)})], "term long")  # of a slice's windows
        chosen = index.join(F.broadcast(terms), "term", "left_semi")
        frequency = {r.term: r.f for r in chosen.where(F.col("term") != DIRECTORY).groupBy("term").agg(F.sum("n").alias("f")).collect()}
        hits.append(chosen.groupBy("block").applyInPandas(tidy_group(_searcher(windows_of(rows, frequency, window), near_terms, slop)), _HITS))
    out = hits[0]
    if n_slices > 1:
        for h in hits[1:]:
            out = out.unionByName(h)
        def joined(c):
            return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

        out = out.groupBy("block", "ord").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            joined("items").alias("items"), joined("near_items").alias("near_items"))
        out = out.withColumn("spans", F.pandas_udf(_merge_spans, "array<int>")("spans"))
    n_hit = F.expr("cast(aggregate(sequence(0, size(spans) - 1), 0, (n, i) -> n + if(i % 2 = 0, -spans[i], spans[i])) as long)")
    return out.select("doc_id", "n_words", F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"),
                      "spans", "items", "near_items")


def _merge_spans(flat: pd.Series) -> pd.Series:
    """Union of the spans of all slices."""
    def one(x) -> list[int]:
        out: list[int] = []
        for a, b in sorted(zip(x[::2], x[1::2], strict=True)):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out

    return flat.map(one)


def contaminated(hits: DataFrame) -> DataFrame:
    """Add the rule: some words hit, and at least one in twenty."""
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rule of ``contaminated`` lets pass.

    Rows are told apart by their text's hash, so null and repeated ids do no harm; a null text stays.
    """
    key = F.xxhash64(f"`{text_col}`")
    hits = find_contamination(docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark, **options)
    (name,) = free(docs, "__bad")
    bad = stage(contaminated(hits).where("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    surely, rest = apart(docs, key, bad, F.col(name))
    return surely.unionByName(rest.join(bad, key == F.col(name), "left_anti"))
