"""Pairwise alignment of distinct (sequence, reference) pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import Fuzzy, compiled, each_text
from ..functions.sequence import fuzzy_regex
from ..sources.shared import bound_batches, materialise

# Affine gaps and match scores.
GAP_OPEN, GAP_EXTEND, MATCH, MISMATCH = 20, 1, 5, -4


#: Cells of a pair that are held at once, a byte each; of a larger pair, the states of this many rows a level.
CELLS, STATES = 1 << 26, 32
# What a cell holds: the best way ends in a match, or in a gap in the reference; such a gap opens here, or one in the sequence; nothing scores.
_MATCHES, _GAP_IN_REF, _OPENS_IN_REF, _OPENS_IN_SEQ, _NOTHING = 1, 2, 4, 8, 16


def _sweep(a: np.ndarray, b: np.ndarray, h: np.ndarray, e: np.ndarray, local: bool, ways: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Run the rows ``a`` from the scores ``h`` and those of gaps in the sequence ``e``: both after the last row, and (score, row, column) of the best end.

    A row is computed as vectors; a gap along it is a running maximum.  ``ways`` gets what each cell's best way ends in.
    """
    slope = np.arange(len(b) + 1, dtype=np.int32) * GAP_EXTEND
    flags = np.zeros((8, len(b)), bool)
    best = (0, 0, 0)
    for i, letter in enumerate(a):
        match = h[:-1] + np.where(b == letter, np.int32(MATCH), np.int32(MISMATCH))
        opened = h - GAP_OPEN
        e = np.maximum(opened, e - GAP_EXTEND)
        h = e.copy()
        h[0] = 0
        np.maximum(h[1:], match, out=h[1:])
        f = np.maximum.accumulate(h + slope)[:-1] - GAP_OPEN - slope[:-1]
        np.maximum(h[1:], f, out=h[1:])
        if local:
            np.maximum(h, 0, out=h)
            k = int(h.argmax())
            best = max(best, (int(h[k]), i + 1, k), key=lambda x: x[0])
        if ways is not None:
            for row, (x, y) in enumerate(((h[1:], match), (h[1:], f), (f, h[:-1] - GAP_OPEN), (e[1:], opened[1:]), (h[1:], 0))):
                np.equal(x, y, out=flags[row])
            ways[i] = np.packbits(flags, 0, "little")[0]
    return h, e, best


class _Path:
    """The way back from the end of an alignment, as runs of operations, last one first."""

    def __init__(self, i: int, k: int, local: bool):
        self.i, self.k, self.local = i, k, local
        self.state, self.runs, self.ended = "M", [], False

    def add(self, op: str, n: int = 1) -> None:
        if self.runs and self.runs[-1][0] == op:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([op, n])

    def follow(self, ways: np.ndarray, first: int) -> None:
        """Walk through the rows after ``first``, whose cells ``ways`` holds."""
        while self.i > first and self.k and not self.ended:
            way = int(ways[self.i - first - 1, self.k - 1])
            if self.state == "M":
                if self.local and way & _NOTHING:
                    self.ended = True
                elif way & _MATCHES:
                    self.add("M")
                    self.i, self.k = self.i - 1, self.k - 1
                else:
                    self.state = "I" if way & _GAP_IN_REF else "D"
                continue
            self.add(self.state)
            opens = way & (_OPENS_IN_REF if self.state == "I" else _OPENS_IN_SEQ)
            if self.state == "I":
                self.k -= 1
            else:
                self.i -= 1
            if opens:
                self.state = "M"


def align_pair(seq: str, ref: str, local: bool = False, cells: int = CELLS) -> tuple[str, str, str, int, int, int]:
    """(CIGAR, aligned ref, aligned seq, score, start in the ref, start in the seq) of an alignment with affine gaps; gaps at the start cost nothing.

    Global: all of both.  ``local``: the best scoring part of both, the first one by its end in the reference, then in the sequence; nothing
    if no letter agrees.  Ties prefer a match, then a gap in the reference, then one in the sequence.

    Memory is linear in the lengths.  Up to ``cells`` cells are held, a byte each.  Of a larger pair the scores of STATES rows are kept, and the way
    back computes the rows between two of them again, the last ones first and only up to its column; parts that are still too large are
    divided the same way.
    """
    a, b = np.frombuffer(ref.encode(), np.uint8), np.frombuffer(seq.encode(), np.uint8)
    n, m = len(a), len(b)
    h, e = np.zeros(m + 1, np.int32), np.full(m + 1, -10**9, np.int32)
    score, path = None, None
    if local:
        ways = np.empty((n, m), np.uint8) if n * m <= cells else None
        score, i, k = _sweep(a, b, h, e, True, ways)[2]
        path = _Path(i, k, True)
        if ways is not None:
            path.follow(ways, 0)
    else:
        path = _Path(n, m, False)
        if not n or not m:
            score = 0
    parts = [(0, path.i, h, e)] if path.i and path.k and not path.ended else []
    while parts and path.k and not path.ended:
        first, last, h, e = parts.pop()
        width = path.k
        column, h, e = b[:width], h[: width + 1], e[: width + 1]
        if last - first == 1 or (last - first) * width <= cells:
            ways = np.empty((last - first, width), np.uint8)
            end = _sweep(a[first:last], column, h, e, local, ways)[0]
            score = int(end[-1]) if score is None else score
            path.follow(ways, first)
            continue
        step = -(-(last - first) // STATES)
        for at in range(first, last, step):
            parts.append((at, min(at + step, last), h, e))
            if at + step < last:
                h, e, _ = _sweep(a[at : at + step], column, h, e, local)
    i, k = (path.i, path.k) if local else (0, 0)
    if not local:
        path.add("D", path.i)
        path.add("I", path.k)
    first_a, first_b, out_a, out_b = i, k, [], []
    for op, length in reversed(path.runs):
        out_a.append("-" * length if op == "I" else ref[i : i + length])
        out_b.append("-" * length if op == "D" else seq[k : k + length])
        i, k = i + (op != "I") * length, k + (op != "D") * length
    return "".join(f"{length}{op}" for op, length in reversed(path.runs)), "".join(out_a), "".join(out_b), score, first_a, first_b


def align_distinct(pairs: DataFrame, local: bool = False) -> DataFrame:
    """``seq, ref`` -> with ``cigar_str, aligned_ref, aligned_seq, alignment_score``, ``local`` with ``start_ref, start_seq``; each distinct pair is aligned once.

    Memory of a task: one batch of pairs, and for the pair at work what ``align_pair`` holds, linear in the two lengths.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, refs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [align_pair(s, r, local) for s, r in zip(seqs, refs, strict=True)]
            cols = list(zip(*found, strict=True)) or [()] * 6
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])]
            yield pa.RecordBatch.from_arrays(arrays, ["seq", "ref", "cigar_str", "aligned_ref", "aligned_seq", "alignment_score", "start_ref", "start_seq"])

    distinct = pairs.select("seq", "ref").where("seq is not null and ref is not null").distinct()
    out = distinct.mapInArrow(run, "seq string, ref string, cigar_str string, aligned_ref string, aligned_seq string, alignment_score long, start_ref long, start_seq long")
    return out if local else out.drop("start_ref", "start_seq")


def align_alleles(df: DataFrame, groups: list[str], start_anchor: str, end_anchor: str, *, refs: DataFrame | None = None, min_group_size: int = 1,
                  fuzzy: bool = True, local: bool = False) -> DataFrame:
    """Align each molecule's sequence, trimmed to its anchors, to its group's reference: given, or the most frequent ``wt`` spacer.

    ``fuzzy`` anchors may hold one wrong, or lack one, letter.  A sequence is kept from its first start anchor to the first end anchor behind it; those without both go.
    Groups with fewer than ``min_group_size`` trimmed reads, or without a reference, are left out.  Group sizes, references and alignments come from the stored
    counts of distinct trimmed reads; the reads themselves are read once more, to meet their alignment.
    """
    a, b = (fuzzy_regex(x) if fuzzy else x for x in (start_anchor, end_anchor))
    bound_batches(df.sparkSession)

    @F.arrow_udf("string")
    def trimmed(seqs: pa.Array) -> pa.Array:
        pattern, first = compiled(f"(?:{a}).*?(?:{b})"), Fuzzy(start_anchor)

        def trim(s: str) -> str | None:
            found = filter(None, (pattern.match(s, at) for at in first.starts(s))) if fuzzy and first.half else pattern.finditer(s)
            m = next(iter(found), None)
            return m and m[0]

        return each_text(seqs, trim, pa.string())

    cut = df.withColumn("seq", trimmed("seq")).where("seq is not null")
    counts = [F.count("*").alias("n"), *([F.count_if("wt").alias("wts")] if refs is None else [])]
    texts = materialise(cut.groupBy(*groups, "seq").agg(*counts), "texts")
    n = texts.groupBy(*groups).agg(F.sum("n").alias("n")).where(F.col("n") >= min_group_size).select(*groups)
    if refs is None:
        wt = texts.where("wts > 0").groupBy(*groups).agg(F.min(F.struct((-F.col("wts")).alias("m"), F.col("seq").alias("r"))).alias("b"))
        refs = wt.select(*groups, F.col("b.r").alias("ref"))
    keyed = materialise(texts.select(*groups, "seq").join(n, groups, "left_semi").join(refs, groups), "pairs")
    aligned = materialise(keyed.join(align_distinct(keyed, local), ["seq", "ref"]), "aligned")
    # columns as of a join of the reads with their references and then with the alignments
    rest = [c for c in cut.columns if c not in (*groups, "seq")]
    given = [c for c in aligned.columns if c not in ("seq", "ref", *groups)]
    return cut.join(aligned, [*groups, "seq"]).select("seq", "ref", *groups, *rest, *given)


def coverage_by_position(alignments: DataFrame, max_range: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """Depth at each reference position from 0 up to ``max_range``, zero-filled, from ``start`` and ``end`` (exclusive)."""
    events = alignments.select(*groups, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("x")).select(*groups, "x.*")
    net = events.groupBy(*groups, "pos").agg(F.sum("d").alias("d"))
    spine = alignments.sparkSession.range(max_range).select(F.col("id").cast("int").alias("pos"))
    if groups:
        spine = alignments.select(*groups).distinct().crossJoin(spine)
    w = Window.partitionBy(*groups).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # max_range positions a group
    return spine.join(net, [*groups, "pos"], "left").select(*groups, "pos", F.sum(F.coalesce("d", F.lit(0))).over(w).alias("coverage"))


def coverage_compare(raw: DataFrame, contigs: DataFrame, first: int, last: int) -> DataFrame:
    """Two depth tracks over a region, each as share of its sum, side by side; null where a track has no position."""
    def share(df: DataFrame, name: str) -> DataFrame:
        part = df.where(F.col("pos").between(first, last))
        total = part.agg(F.sum("coverage").alias("total"))
        return part.crossJoin(F.broadcast(total)).select("pos", (F.col("coverage") / F.col("total")).alias(name))

    return share(raw, "raw").join(share(contigs, "contigs"), "pos", "full_outer")
