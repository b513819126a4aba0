"""k-mers, de Bruijn edges and assembly of UMIs."""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bound_batches, materialise
from .contigs import shortest_contigs
from .intervals import free_names
from .unitigs import longest_unitigs

#: Edges of one graph that a task walks in Python, and letters of the distinct reads of one group whose k-mers it counts.
TASK_EDGES = 1_000_000
#: Letters of reads and contigs that a worker remembers.
KNOWN_LETTERS = 32 << 20
#: Letters of reads whose shortest contigs are looked for together, and of a group whose k-mers are counted and walked one by one.
TOGETHER_LETTERS, LONE_LETTERS = 1 << 15, 1 << 16


def kmer_explode(df: DataFrame, seq: str, k: int = 15, only_unique: bool = True, max_str_len: int = 1 << 30) -> DataFrame:
    """One row for each k-mer, or the first ``max_str_len``; ``only_unique`` keeps those that stand once in the whole frame."""
    s = F.col(seq)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.least(F.lit(max_str_len), F.length(s) - k + 1)))
    out = df.withColumn("kmer", F.explode(F.transform(starts, lambda i: F.substring(s, i, F.lit(k)))))
    if not only_unique:
        return out
    once = out.groupBy("kmer").agg(F.count("*").alias("__n")).where("__n = 1").select("kmer")
    return out.join(once, "kmer", "left_semi")


def kmer_counts(df: DataFrame, group: str, seq: str, k: int) -> DataFrame:
    """Per group and k-mer the number of reads that hold it."""
    s = F.col(seq)
    kmers = F.when(F.length(s) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))))
    return df.select(group, F.explode(kmers).alias("kmer")).groupBy(group, "kmer").agg(F.count("*").alias("reads"))


def debruijn_edges(df: DataFrame, groups: list[str], seq: str, k: int) -> DataFrame:
    """Edges between consecutive (k-1)-mers with their multiplicity."""
    each = kmer_explode(df.select(*groups, seq), seq, k, only_unique=False, max_str_len=1 << 30)
    n = each.groupBy(*groups, "kmer").agg(F.count("*").alias("count"))
    return n.select(*groups, F.substring("kmer", 1, k - 1).alias("src"), F.substring("kmer", 2, k - 1).alias("dst"), "count")


def _path(edges: dict[str, list[tuple[str, int]]], start: str, end: str) -> str:
    """Shortest walk of (k-1)-mers from ``start`` to ``end``; ties by higher coverage, then by text; empty if none.

    Nodes are met level by level and keep the node before them.  Texts of a level are compared by their places in it: of two of equal length
    the one whose beginning was smaller is, then the one with the smaller last letter.
    """
    came: dict[str, str] = {start: ""}
    level = {start: (0, 0)}
    while level and end not in came:
        best: dict[str, tuple[int, int, str]] = {}
        for node, (cost, rank) in level.items():
            for nxt, n in edges.get(node, ()):
                if nxt not in came and (nxt not in best or (cost - n, rank, node) < best[nxt]):
                    best[nxt] = (cost - n, rank, node)
        level = {node: (best[node][0], i) for i, node in enumerate(sorted(best, key=lambda v: (best[v][1], v[-1])))}
        came |= {node: before for node, (_, _, before) in best.items()}
    if end not in came:
        return ""
    letters, at = [], end
    while at != start:
        letters.append(at[-1])
        at = came[at]
    return start + "".join(reversed(letters))


def _unitig(edges: dict[str, list[tuple[str, int]]]) -> str:
    """The longest text along nodes with one way in and one way out; ties by text."""
    ins: dict[str, int] = defaultdict(int)
    for outs in edges.values():
        for nxt, _ in outs:
            ins[nxt] += 1
    best = ""
    seen: set[str] = set()
    for node in sorted(set(edges) | set(ins)):
        if ins[node] == 1 and len(edges.get(node, ())) == 1:
            continue  # inside a unitig
        for first, _ in edges.get(node, ()):
            letters, at = [node, first[-1]], first
            while ins[at] == 1 and len(edges.get(at, ())) == 1:
                seen.add(at)
                at = edges[at][0][0]
                letters.append(at[-1])
            best = min(best, "".join(letters), key=lambda t: (-len(t), t))
    for node in sorted(edges):  # rings
        if node not in seen and ins[node] == 1 and len(edges[node]) == 1:
            letters, at = [node], edges[node][0][0]
            while at != node:
                seen.add(at)
                letters.append(at[-1])
                at = edges[at][0][0]
            best = min(best, "".join(letters), key=lambda t: (-len(t), t))
    return best


def assemble_umis(df: DataFrame, groups: list[str], *, seq: str = "r2_seq", k: int = 15, min_coverage: int = 20, method: str = "shortest_path",
                  start_anchor: str = "", end_anchor: str = "", min_length: int = 0, task_edges: int | None = None, top: str | None = None) -> DataFrame:
    """One contig a group by its de Bruijn graph; empty if there is none of ``min_length``.  ``top`` names a column for the group's most frequent read.

    The walk is of ``_assembled``, for one k and coverage."""
    return _assembled(df, groups, [k], [min_coverage], seq=seq, method=method, start_anchor=start_anchor, end_anchor=end_anchor, min_length=min_length, task_edges=task_edges, top=top).drop("k", "min_coverage")


def _contig(graph: dict[str, list[tuple[str, int]]], k: int, method: str, start_anchor: str, end_anchor: str) -> str:
    """The contig of one graph, whose edges are in order of their texts."""
    if method != "shortest_path":
        return _unitig(graph)
    nodes = set(graph) | {b for outs in graph.values() for b, _ in outs}
    first = min((n for n in nodes if n.startswith(start_anchor[: k - 1])), default="")
    last = min((n for n in nodes if n.endswith(end_anchor[-(k - 1) :])), default="")
    return _path(graph, first, last) if first and last else ""


def _contigs(reads: dict[str, int], ks: list[int], coverages: list[int], method: str, start_anchor: str, end_anchor: str, min_length: int) -> list[str]:
    """The contigs of one group's distinct reads and their numbers, for each k and coverage."""
    out = []
    for k in ks:
        counts: dict[str, int] = defaultdict(int)
        for s, n in reads.items():
            for i in range(len(s) - k + 1):
                counts[s[i : i + k]] += n
        edges = sorted(counts.items())
        for c in coverages:
            graph: dict[str, list[tuple[str, int]]] = defaultdict(list)
            for kmer, n in edges:
                if n >= c:
                    graph[kmer[:-1]].append((kmer[1:], n))
            contig = _contig(graph, k, method, start_anchor, end_anchor)
            out.append(contig if len(contig) >= min_length else "")
    return out


class _Contigs:
    """What a worker remembers: the contigs of groups with the same reads, up to KNOWN_LETTERS letters; those used last stay."""

    def __init__(self, options: tuple):
        self.options, self.known, self.held = options, OrderedDict(), 0

    def get(self, key: tuple) -> list[str] | None:
        if key in self.known:
            self.known.move_to_end(key)
        return self.known.get(key)

    def learn(self, key: tuple, found: list[str]) -> None:
        size = sum(len(x) for x, _ in key) + sum(map(len, found))
        if size <= KNOWN_LETTERS // 8:
            self.known[key] = found
            self.held += size
            while self.held > KNOWN_LETTERS:
                old, gone = self.known.popitem(last=False)
                self.held -= sum(len(x) for x, _ in old) + sum(map(len, gone))


_contigs_known: _Contigs | None = None


def _known_contigs(options: tuple) -> _Contigs:
    """The worker's contigs of these options, kept from task to task; those of others are forgotten."""
    global _contigs_known
    if _contigs_known is None or _contigs_known.options != options:
        _contigs_known = _Contigs(options)
    return _contigs_known


def _best(found: list[str], grid: list[tuple[int, int]], start_anchor: str, end_anchor: str, longest: bool) -> int:
    """The place of a group's contig that holds both anchors, then of the longest (or longest first), then of the smallest k and coverage."""
    def rank(i: int) -> tuple:
        both, n = start_anchor in found[i] and end_anchor in found[i], len(found[i])
        return (*((n, both) if longest else (both, n)), -grid[i][0], -grid[i][1], found[i])

    return max(range(len(grid)), key=rank)


def _assembled(df: DataFrame, groups: list[str], ks: list[int], coverages: list[int], *, seq: str = "r2_seq", method: str = "shortest_path",
               start_anchor: str = "", end_anchor: str = "", min_length: int = 0, task_edges: int | None = None, top: str | None = None,
               counted: str | None = None, min_reads: int = 1, null_keys: bool = True, longest: bool | None = None) -> DataFrame:
    """Groups x k x coverage with a contig each; ``top`` names a column for a group's most frequent read, ties by text, ``counted`` one for its number of rows.

    Reads are cut to [start anchor, end anchor] where they hold them and shuffled once.  The reads of a group stand together in a sorted partition,
    copies in a row, so copies are counted, groups below ``min_reads`` (and without ``null_keys`` those of a null) left out, k-mers counted, those below the coverage dropped and the edges walked where the reads are:
    ``shortest_path`` from the start to the end anchor's (k-1)-mer, for many groups at once, or ``compression``, the longest unitig.  Groups with the same reads are
    assembled once a worker.  With ``longest`` given the best contig of a group alone is told, see ``_best``.  Of a group with more than ``task_edges`` letters in distinct
    reads the k-mers are counted by tables; a graph of more edges is compressed by tables too, with the same text; its shortest path is one task's work at any size.
    """
    bound_batches(df.sparkSession)
    bound = TASK_EDGES if task_edges is None else task_edges
    s, whole = F.col(seq), F.lit(1 << 30)
    if start_anchor:
        s = F.substring(s, F.greatest(F.instr(s, start_anchor), F.lit(1)), whole)
    if end_anchor:
        s = F.substring(s, F.lit(1), F.pmod(F.instr(s, end_anchor) - 1, whole) + len(end_anchor))  # each place is looked for once; none: the whole text
    cut = df.select(*groups, s.alias("__s"))
    beside = {c: kind for c, kind in ((top, "string"), (counted, "bigint")) if c}
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema)
    schema = kinds + ", k int, min_coverage int, contig string" + "".join(f", `{c}` {kind}" for c, kind in beside.items())
    names, width, grid = [*groups, "k", "min_coverage", "contig", *beside], len(groups), [(k, c) for k in ks for c in coverages]
    options = (tuple(ks), tuple(coverages), method, start_anchor, end_anchor, min_length)
    at_once = method == "shortest_path" and min(ks, default=0) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known_contigs(options)
        waiting: dict[tuple, list[tuple]] = {}  # reads of groups that are assembled together, and the groups
        queued = 0
        rows: list[tuple] = []

        def tell(group: tuple, found: list[str | None], others: tuple) -> None:
            places = range(len(grid)) if longest is None else [_best(found, grid, start_anchor, end_anchor, longest) if found[0] is not None else 0]
            rows.extend((*group, *grid[i], found[i], *others) for i in places)

        def assemble() -> None:
            nonlocal queued
            for (key, same), found in zip(waiting.items(), shortest_contigs(list(waiting), ks, coverages, start_anchor, end_anchor), strict=True):
                found = [x if len(x) >= min_length else "" for x in found]
                known.learn(key, found)
                for group, others in same:
                    tell(group, found, others)
            waiting.clear()
            queued = 0

        def close(group: tuple, reads: dict[str, int], best: tuple[int, str] | None, letters: int, n: int) -> None:
            nonlocal queued
            if n < min_reads or not null_keys and None in group:
                return
            others = (*((best and best[1],) if top else ()), *((n,) if counted else ()))
            if letters > bound:
                return tell(group, [None] * len(grid), others)  # by tables
            key = tuple(reads.items())  # in order of the texts
            if (found := known.get(key)) is not None:
                return tell(group, found, others)
            if key in waiting:
                return waiting[key].append((group, others))
            if at_once and letters <= LONE_LETTERS:
                waiting[key] = [(group, others)]
                queued += letters
                return assemble() if queued >= TOGETHER_LETTERS else None
            found = _contigs(reads, ks, coverages, method, start_anchor, end_anchor, min_length)
            known.learn(key, found)
            tell(group, found, others)

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return out

        def lines() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [*(f.type for f in list(batch.schema)[:width]), pa.int32(), pa.int32(), pa.string(), *(pa.string() if c == top else pa.int64() for c in beside)]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        types: list[pa.DataType] = []
        group, reads, best, letters, copies = None, {}, None, 0, 0
        for (*g, s), same in groupby(lines()):
            n = sum(1 for _ in same)
            if g != group:
                if group is not None:
                    close(tuple(group), reads, best, letters, copies)
                    if len(rows) > 10_000:
                        yield told()
                group, reads, best, letters, copies = g, {}, None, 0, 0
            copies += n
            if s is None:
                continue
            if best is None or n > best[0]:
                best = n, s
            letters += len(s)
            if letters <= bound:
                reads[s] = n
            else:
                reads.clear()
        if group is not None:
            close(tuple(group), reads, best, letters, copies)
        if waiting:
            assemble()
        if rows:
            yield told()

    # the session's number of tasks: by the bytes of the reads alone Spark would make too few for the work on them
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = cut.repartition(tasks, *groups).sortWithinPartitions(*groups, "__s")
    found = materialise(together.mapInArrow(run, schema), "contigs")
    large = found.where("contig is null")
    columns = [*groups, "contig", "k", "min_coverage", *beside]
    if large.isEmpty():
        return found.select(*columns)
    marks = free_names(found, *(f"of_{c}" for c in groups))
    large = large.select(*(F.col(c).alias(m) for c, m in zip(groups, marks, strict=True)), *beside).distinct()  # a row for each ``bound`` letters at most
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(m)) for c, m in zip(groups, marks, strict=True)))
    distinct = cut.join(large.select(*marks), same, "left_semi").groupBy(*groups, "__s").agg(F.count("*").alias("__n"))
    texts = _by_tables(distinct, groups, ks, coverages, kinds, method, start_anchor, end_anchor, min_length, bound)
    if longest is not None:
        both, n = (F.col("contig").contains(start_anchor) & F.col("contig").contains(end_anchor)).cast("int"), F.length("contig")
        rank = F.struct(*([n, both] if longest else [both, n]), -F.col("k"), -F.col("min_coverage"), F.col("contig"))
        (b,) = free_names(texts, "best")
        texts = texts.groupBy(*groups).agg(F.max_by(F.struct("contig", "k", "min_coverage"), rank).alias(b)).select(*groups, *(f"{b}.{c}" for c in ("contig", "k", "min_coverage")))
    if beside:
        texts = texts.join(large, same).drop(*marks)
    return found.where("contig is not null").select(*columns).unionByName(texts.select(*columns))


def _by_tables(distinct: DataFrame, groups: list[str], ks: list[int], coverages: list[int], kinds: str, method: str, start_anchor: str, end_anchor: str, min_length: int, bound: int) -> DataFrame:
    """The contigs of large groups, from the distinct reads ``__s`` and their numbers ``__n``: k-mers are counted by Spark."""
    each = distinct.select(*groups, "__s", "__n", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    starts = F.when(F.length("__s") >= F.col("k"), F.sequence(F.lit(1), F.length("__s") - F.col("k") + 1))
    n = each.select(*groups, "k", "__n", F.explode(F.transform(starts, lambda i: F.substring("__s", i, F.col("k")))).alias("kmer")).groupBy(*groups, "k", "kmer").agg(F.sum("__n").alias("count"))
    cuts = F.explode(F.filter(F.array(*map(F.lit, coverages)), lambda c: c <= F.col("count")))
    edges = n.select(*groups, "k", F.expr("substr(kmer, 1, k - 1)").alias("src"), F.expr("substr(kmer, 2)").alias("dst"), "count", cuts.alias("min_coverage"))
    keys = [*groups, "k", "min_coverage"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for a, b, n in sorted(zip(pdf["src"], pdf["dst"], pdf["count"], strict=True)):
            graph[a].append((b, int(n)))
        contig = _contig(graph, int(pdf["k"].iloc[0]), method, start_anchor, end_anchor)
        return pdf[keys].head(1).assign(contig=contig if len(contig) >= min_length else "")

    schema = kinds + ", k int, min_coverage int, contig string"
    large = None
    if method != "shortest_path":
        edges = materialise(edges, "edges")
        n, g, *marks = free_names(edges, "n", "g", *(f"of_{c}" for c in keys))
        large = edges.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > bound)
        large = materialise(large.select(*(F.col(c).alias(m) for c, m in zip(keys, marks, strict=True)), F.monotonically_increasing_id().alias(g)), "large-graphs")  # a row for each ``bound`` edges at most
    if large is None or large.isEmpty():
        found = edges.groupBy(*keys).applyInPandas(walk, schema)
    else:
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(m)) for c, m in zip(keys, marks, strict=True)))
        texts = longest_unitigs(edges.join(large, same).select(F.col(g).alias("g"), "src", "dst")).withColumnRenamed("g", g)
        long_enough = F.when(F.length("contig") >= min_length, F.col("contig")).otherwise("")
        texts = large.join(texts, g).select(*(F.col(m).alias(c) for c, m in zip(keys, marks, strict=True)), long_enough.alias("contig"))
        found = edges.join(large, same, "left_anti").groupBy(*keys).applyInPandas(walk, schema).unionByName(texts)
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("min_coverage")) for k in ks for c in coverages)))
    (cell,) = free_names(distinct, "cell")
    every = distinct.select(*groups).distinct().select(*groups, grid.alias(cell)).select(*groups, f"{cell}.k", f"{cell}.min_coverage")
    marks = free_names(every, *(f"of_{c}" for c in keys))
    found = found.withColumnsRenamed(dict(zip(keys, marks, strict=True)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(m)) for c, m in zip(keys, marks, strict=True)))
    return every.join(found, same, "left").select(*groups, F.coalesce("contig", F.lit("")).alias("contig"), "k", "min_coverage")


def assembly_sweep(df: DataFrame, groups: list[str], ks: list[int], coverages: list[int], **options) -> DataFrame:
    """Contigs for every k and coverage of a grid: the reads are read once, their k-mers of all lengths counted together, and coverages cut the counts."""
    return _assembled(df, groups, ks, coverages, **options)


def assembly_optimize(df: DataFrame, groups: list[str], ks: list[int], coverages: list[int], *, start_anchor: str, end_anchor: str, prioritize_length: bool = False,
                      min_reads: int = 1, **options) -> DataFrame:
    """Per group of at least ``min_reads`` reads the contig that holds both anchors, then the longest (or longest first); ``failed`` if empty.

    The reads of a group are counted and its best contig chosen where they are assembled."""
    best = _assembled(df, groups, ks, coverages, start_anchor=start_anchor, end_anchor=end_anchor, min_reads=min_reads, null_keys=min_reads == 1, longest=prioritize_length, **options)
    return best.select(*groups, "contig", "k", "min_coverage", (F.length("contig") == 0).alias("failed"))


def contig_table(df: DataFrame, groups: list[str], min_reads: int, sample_id: str, *, k: int = 15, min_coverage: int = 20, **options) -> DataFrame:
    """Contigs of groups with at least ``min_reads`` reads, with length, sample and reads, which are counted where they are assembled."""
    contigs = _assembled(df, groups, [k], [min_coverage], counted="reads", min_reads=min_reads, null_keys=False, **options).drop("k", "min_coverage")
    return contigs.withColumns({"length": F.length("contig"), "sample_id": F.lit(sample_id)})


def assembly_metrics(contigs: DataFrame) -> DataFrame:
    """Share and number of contigs that are not empty, and mean and median of their length."""
    n = F.when(F.length("contig") > 0, F.length("contig"))
    return contigs.agg(F.avg((F.length("contig") > 0).cast("int")).alias("success_rate"), F.count(n).alias("total_assembled"),
                       F.avg(n).alias("mean_length"), F.median(n).alias("median_length"))


#: k-mers of references that every task gets; with more, all k-mers of the contigs are joined.
KNOWN_KMERS = 1_000_000
_FACTOR, _WORD, _SLOTS = 0x9E3779B97F4A7C15, 1 << 64, 20


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _codes(letters: np.ndarray, k: int, factor: int) -> np.ndarray:
    """A number for each k consecutive letters, equal for equal ones: a stretch's from those of its two parts."""
    power, out, done, width = letters.astype(np.uint64) + np.uint64(1), None, 0, 1
    if len(power) < k:
        return power[:0]
    while True:
        if k & 1:
            out = power if out is None else out[: len(power) - done] * np.uint64(pow(factor, width, _WORD)) + power[done:]
            done += width
        k >>= 1
        if not k:
            return out
        power = power[:-width] * np.uint64(pow(factor, width, _WORD)) + power[width:]
        width *= 2


class _Known:
    """k-mers with their references, all different, found in many texts at once: by their codes, then letter by letter."""

    def __init__(self, k: int, own: list[tuple[str, str]]):
        self.k, factor = k, _FACTOR
        while True:
            codes = np.array([_codes(_letters(kmer), k, factor)[0] for kmer, _ in own], np.uint64)
            order = np.argsort(codes)
            self.codes, self.factor = codes[order], factor
            if (self.codes[1:] != self.codes[:-1]).all():
                break
            factor = factor * _FACTOR % _WORD
        self.letters = np.array([_letters(own[i][0]).astype(np.uint32) for i in order])
        self.mods = pa.array([own[i][1] for i in order], pa.string()).dictionary_encode("encode")
        self.number = self.mods.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self.codes >> np.uint64(64 - _SLOTS)] = True

    def mods_of(self, texts: list[str]) -> pa.ListArray:
        """For each text the references of which it holds a k-mer."""
        letters, ends = _letters("".join(texts)), np.cumsum([len(x) for x in texts])
        codes = _codes(letters, self.k, self.factor)
        at = np.flatnonzero(self.slots[codes >> np.uint64(64 - _SLOTS)])
        place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        row = np.searchsorted(ends, at, "right")
        same = (self.codes[place] == codes[at]) & (at + self.k <= ends[row])
        at, place, row = at[same], place[same], row[same]
        same = (letters[at[:, None] + np.arange(self.k)] == self.letters[place]).all(axis=1)
        held = np.unique(row[same] * len(self.mods.dictionary) + self.number[place[same]])
        offsets = np.searchsorted(held, np.arange(len(texts) + 1) * len(self.mods.dictionary))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.mods.dictionary.take(pa.array(held % len(self.mods.dictionary))))


def kmer_classify(contigs: DataFrame, refs: DataFrame, k: int = 25, known_kmers: int | None = None) -> DataFrame:
    """Per integration barcode the reference whose own k-mers most UMIs share: ``intBC, mod, fps``; ties by name.

    Up to ``known_kmers`` own k-mers are sent to the tasks, which give a row for each reference that a contig shares one with; more are joined with all k-mers.
    """
    known_kmers = KNOWN_KMERS if known_kmers is None else known_kmers
    own = materialise(kmer_explode(refs.select("mod", F.col("seq").alias("ref_seq")), "ref_seq", k, max_str_len=1 << 30).select("kmer", "mod"), "kmers")
    listed = own.limit(known_kmers + 1).collect()
    if 0 < len(listed) <= known_kmers:
        bound_batches(contigs.sparkSession)
        known = contigs.sparkSession.sparkContext.broadcast(_Known(k, [(r.kmer, r.mod) for r in listed]))

        @F.arrow_udf("array<string>")
        def mods(texts: pa.Array) -> pa.Array:
            coded = texts.fill_null("").dictionary_encode()
            return known.value.mods_of(coded.dictionary.to_pylist()).take(coded.indices)

        shared = contigs.select("intBC", "sbc", "umi", F.explode(mods("contig")).alias("mod"))
    else:
        each = kmer_explode(contigs.select("intBC", "sbc", "umi", "contig"), "contig", k, only_unique=False, max_str_len=1 << 30).select("intBC", "sbc", "umi", "kmer")
        shared = each.join(own, "kmer")
    fps = shared.groupBy("intBC", "mod", "sbc").agg(F.countDistinct("umi").alias("n")).groupBy("intBC", "mod").agg(F.sum("n").alias("fps"))
    return fps.groupBy("intBC").agg(F.min(F.struct((-F.col("fps")).alias("m"), F.col("mod"))).alias("b")).select("intBC", "b.mod", (-F.col("b.m")).alias("fps"))
