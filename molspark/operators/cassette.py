"""Cassettes: masking, segmentation by METAs, per-segment assembly, stitching and transition statistics."""

from __future__ import annotations

import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import compiled, each_text
from ..functions.sequence import extract_or_null, fuzzy_regex, scramble_text
from ..sources.shared import bound_batches
from .kmers import assemble_umis
from .reads import fuzzy_sanitize

# The length of a META and the names that stand for the cassette's ends.
META_LEN = 20
CASSETTE_START, CASSETTE_END = "_CASSETTE_START_", "_CASSETTE_END_"


def _maybe_fuzzy(text: str, fuzzy: bool, wildcard: str) -> str:
    return fuzzy_regex(text, wildcard) if fuzzy else text


def _swap_after(df: DataFrame, col: str, rules: list[tuple[str, str, str]], fuzzy: bool, wildcard: str) -> DataFrame:
    """For each (meta, from, to) replace the first ``from`` behind ``meta``; rules number METAs times targets."""
    for meta, old, new in rules:
        pattern = f"({_maybe_fuzzy(meta, fuzzy, wildcard)})(.*?)({_maybe_fuzzy(old, fuzzy, wildcard)})(.*$)"
        df = df.withColumn(col, F.regexp_replace(col, pattern, f"$1$2{new}$4"))
    return df


def mask_rules(metas: dict[str, str], targets: dict[str, str]) -> list[tuple[str, str, str]]:
    """(META sequence, target, scramble of the target for this pair)."""
    return [(ms, ts, scramble_text(f"{m}_{t}", ts)) for m, ms in metas.items() for t, ts in targets.items()]


def mask_repeats(df: DataFrame, metas: dict[str, str], targets: dict[str, str], col: str, fuzzy: bool = False, wildcard: str = ".{0,1}") -> DataFrame:
    """Each META's next target by a scramble of its own, so that repeats become unique."""
    return _swap_after(df, col, mask_rules(metas, targets), fuzzy, wildcard)


def unmask_repeats(df: DataFrame, metas: dict[str, str], targets: dict[str, str], col: str, fuzzy: bool = False, wildcard: str = ".{0,1}") -> DataFrame:
    """The inverse of ``mask_repeats``."""
    return _swap_after(df, col, [(m, new, old) for m, old, new in mask_rules(metas, targets)], fuzzy, wildcard)


def flank_rules(metas: dict[str, str], edited: dict[str, tuple[str, str]]) -> list[tuple[str, str, str, str, str]]:
    """(META, left, right, scrambled left, scrambled right)."""
    return [(ms, left, right, scramble_text(f"{m}_{t}_L", left), scramble_text(f"{m}_{t}_R", right)) for m, ms in metas.items() for t, (left, right) in edited.items()]


def _swap_flanks(df: DataFrame, col: str, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    for meta, left, right, new_left, new_right in rules:
        df = df.withColumn(col, F.regexp_replace(col, f"({meta})(.*?)({left})(.{{0,5}})({right})(.*$)", f"$1$2{new_left}$4{new_right}$6"))
    return df


def mask_flanks(df: DataFrame, metas: dict[str, str], edited: dict[str, tuple[str, str]], col: str) -> DataFrame:
    """Scramble both flanks of each edited target behind each META; the mark of 0 to 5 bases between stays."""
    return _swap_flanks(df, col, flank_rules(metas, edited))


def unmask_flanks(df: DataFrame, metas: dict[str, str], edited: dict[str, tuple[str, str]], col: str) -> DataFrame:
    """The inverse of ``mask_flanks``."""
    return _swap_flanks(df, col, [(m, nl, nr, left, right) for m, left, right, nl, nr in flank_rules(metas, edited)])


def flag_aberrant(df: DataFrame, metas: dict[str, str], col: str) -> DataFrame:
    """``is_aberrant``: some META stands more than once."""
    counts = F.array(*(F.regexp_count(F.col(col), F.lit(m)) for m in metas.values()))
    return df.withColumn("is_aberrant", F.exists(counts, lambda c: c > 1))


def segment_by_metas(df: DataFrame, metas: dict[str, str], start_anchor: str, end_anchor: str, col: str, keep: list[str], wildcard: str | None = ".{0,1}") -> DataFrame:
    """Segments between consecutive METAs and from the cassette's ends to the first and last META.

    ``keep, start_meta, end_meta, segment_seq``.  All pairs of a read are made inside its row, so there is no join, shuffle
    or need for a read key.  Places are first occurrences.
    """
    if wildcard:
        df = fuzzy_sanitize(df, list(metas.values()), [start_anchor, end_anchor], col, wildcard)
    bound_batches(df.sparkSession)

    @F.arrow_udf(_SEGMENTS)
    def segments(seqs: pa.Array) -> pa.Array:
        pattern = compiled("(" + "|".join(metas.values()) + ")")
        return each_text(seqs, lambda s: _segments(s, pattern, metas, start_anchor, end_anchor), _SEGMENT_TYPE)

    return df.select(*keep, F.inline(segments(F.col(col))))


_SEGMENTS = "array<struct<start_meta:string,end_meta:string,segment_seq:string>>"
_SEGMENT_TYPE = pa.list_(pa.struct([(x, pa.string()) for x in ("start_meta", "end_meta", "segment_seq")]))


def _segments(s: str, pattern: re.Pattern, metas: dict[str, str], start_anchor: str, end_anchor: str) -> list[tuple[str | None, str | None, str]]:
    """The segments of one text; one whose end stands before its start is empty."""
    named = {seq: name for name, seq in metas.items()}
    hits = [m[1] for m in pattern.finditer(s)]
    out = [(named.get(a), named.get(b), s[s.find(a) : s.find(b) + len(b)]) for a, b in pairwise(hits)]
    places = [(p, name) for name, seq in metas.items() if (p := s.find(seq)) >= 0]
    a0, b0 = s.find(start_anchor), s.find(end_anchor)
    if a0 >= 0 and (behind := [x for x in places if x[0] > a0]):
        p, name = min(behind)
        out.append((CASSETTE_START, name, s[a0 : p + META_LEN]))
    if b0 >= 0 and (before := [x for x in places if x[0] < b0]):
        p, name = max(before)
        out.append((name, CASSETTE_END, s[p : b0 + len(end_anchor)]))
    return out


def boundary_kmers(metas: dict[str, str], start_anchor: str, end_anchor: str) -> dict[str, str]:
    return {**metas, CASSETTE_START: start_anchor, CASSETTE_END: end_anchor}


def validate_assembly(assembled: DataFrame, bounds: dict[str, str], k: int, col: str = "contig") -> DataFrame:
    """``is_valid``: the contig holds the last k of its start and the first k of its end."""
    tail = F.create_map(*(F.lit(x) for n, s in bounds.items() for x in (n, s[-k:])))
    head = F.create_map(*(F.lit(x) for n, s in bounds.items() for x in (n, s[:k])))
    c = F.col(col)
    return assembled.withColumn("is_valid", F.coalesce(c.contains(tail[F.col("start_meta")]) & c.contains(head[F.col("end_meta")]), F.lit(False)))


def fallback_consensus(segments: DataFrame, assembled: DataFrame, groups: list[str]) -> DataFrame:
    """Valid contigs, and for groups without one their most frequent raw segment (ties: the smallest)."""
    valid = assembled.where("is_valid").select(*groups, F.col("contig").alias("segment_seq"), F.lit(False).alias("is_fallback"))
    rest = segments.join(valid.select(*groups), groups, "left_anti").groupBy(*groups, "segment_seq").agg(F.count("*").alias("n"))
    top = rest.groupBy(*groups).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("segment_seq").alias("s"))).alias("b"))
    return valid.unionByName(top.select(*groups, F.col("b.s").alias("segment_seq"), F.lit(True).alias("is_fallback")))


def target_insertions(df: DataFrame, edited: dict[str, tuple[str, str]], col: str) -> DataFrame:
    """``{target}_ins``: up to 6 bases between the last 8 of the left and the first 8 of the right flank; null without both."""
    return df.withColumns({f"{t}_ins": extract_or_null(F.col(col), f"{left[-8:]}(.{{0,6}}?){right[:8]}", 1) for t, (left, right) in edited.items()})


def stitch_segments(df: DataFrame, metas: list[str], groups: list[str], col: str = "segment_seq") -> DataFrame:
    """Segments of a molecule in META order, joined; all but those of the smallest order lose their first META_LEN bases.

    Segments are ordered by their start, then by end and sequence.  Those of an unknown start come first and are cut too.
    """
    order = F.create_map(*(F.lit(x) for i, m in enumerate([CASSETTE_START, *metas]) for x in (m, i - 1)))
    parts = F.array_sort(F.collect_list(F.struct(order[F.col("start_meta")].alias("o"), F.col("end_meta").alias("e"), F.col(col).alias("s"))))  # segments of one molecule
    first = F.col("first")
    joined = F.array_join(F.transform("parts", lambda p: F.when(p["o"] == first, p["s"]).otherwise(F.substring(p["s"], F.lit(META_LEN + 1), F.length(p["s"])))), "")
    grouped = df.groupBy(*groups).agg(parts.alias("parts"), F.min(order[F.col("start_meta")]).alias("first"))
    return grouped.select(*groups, joined.alias("stitched_seq"))


def assemble_segmented(df: DataFrame, metas: dict[str, str], edited: dict[str, tuple[str, str]], start_anchor: str, end_anchor: str, *, groups: list[str], col: str,
                       k: int = 15, min_coverage: int = 2) -> DataFrame:
    """Stitched contig of each molecule: reads without repeated METAs are segmented, each segment type of a molecule is assembled
    (all in one job), checked at its boundaries, replaced by the most frequent raw segment where that fails, and stitched."""
    reads = flag_aberrant(fuzzy_sanitize(df, list(metas.values()), [start_anchor, end_anchor], col), metas, col).where("not is_aberrant")
    segments = segment_by_metas(reads, metas, start_anchor, end_anchor, col, groups, None).where("segment_seq != ''")
    keys = [*groups, "start_meta", "end_meta"]
    contigs = assemble_umis(segments, keys, seq="segment_seq", k=k, min_coverage=min_coverage, method="compression", top="raw")
    checked = validate_assembly(contigs, boundary_kmers(metas, start_anchor, end_anchor), k)
    best = checked.select(*keys, F.when(F.col("is_valid"), F.col("contig")).otherwise(F.col("raw")).alias("segment_seq"))
    return target_insertions(stitch_segments(best, list(metas), groups), edited, "stitched_seq")


def segment_types(segments: DataFrame, molecule: list[str]) -> DataFrame:
    """Molecules with each transition, and mean and median segment length; a molecule counts once with its smallest segment."""
    one = segments.groupBy(*molecule, "start_meta", "end_meta").agg(F.min("segment_seq").alias("s"))
    n = F.length("s")
    return one.groupBy("start_meta", "end_meta").agg(F.count("*").alias("count"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"))


def _types_per_molecule(segments: DataFrame, molecule: list[str], threshold: float) -> DataFrame:
    """Per molecule the number of transition types, and of those at least ``threshold`` times as frequent as the most frequent."""
    n = segments.groupBy(*molecule, "start_meta", "end_meta").agg(F.count("*").alias("n"))
    top = n.groupBy(*molecule).agg(F.max("n").alias("top"))
    return n.join(top, molecule).groupBy(*molecule).agg(F.count("*").alias("sensitive"), F.sum((F.col("n") >= threshold * F.col("top")).cast("long")).alias("smart"))


def transition_heterogeneity(segments: DataFrame, molecule: list[str], threshold: float = 0.2) -> DataFrame:
    """Per mode: molecules with each number of transition types: ``mode, n_transition_types, molecules``."""
    per = _types_per_molecule(segments, molecule, threshold)
    long = per.select(F.explode(F.array(F.struct(F.lit("sensitive").alias("mode"), F.col("sensitive").alias("n_transition_types")),
                                        F.struct(F.lit("smart").alias("mode"), F.col("smart").alias("n_transition_types")))).alias("x")).select("x.*")
    return long.groupBy("mode", "n_transition_types").agg(F.count("*").alias("molecules"))


def meta_presence(contigs: DataFrame, features: dict[str, str], col: str = "contig") -> DataFrame:
    """Per feature the contigs that hold it, and their percent."""
    each = contigs.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(col).contains(s).cast("long").alias("has")) for n, s in features.items()))).alias("x"))
    return each.groupBy("x.feature").agg(F.sum("x.has").alias("contigs"), (100 * F.avg("x.has")).alias("percent"))


def transition_pairs(types: DataFrame, metas: list[str], top: int | None = None) -> DataFrame:
    """Transitions with share of all, METAs skipped (null at the ends) and whether they are adjacent; the ``top`` most frequent."""
    order = F.create_map(*(F.lit(x) for i, m in enumerate(metas) for x in (m, i)))
    total = types.agg(F.sum("count").alias("total"))
    skipped = order[F.col("end_meta")] - order[F.col("start_meta")] - 1
    out = types.crossJoin(F.broadcast(total)).select("start_meta", "end_meta", "count", (100 * F.col("count") / F.col("total")).alias("percent"),
                                                     skipped.alias("skipped"), (skipped == 0).alias("adjacent"))
    return out if top is None else out.orderBy(F.desc("count"), "start_meta", "end_meta").limit(top)


def transition_matrix(types: DataFrame, metas: list[str]) -> DataFrame:
    """Percent of all transitions: a row a start, a column an end, zero where there is none."""
    total = types.agg(F.sum("count").alias("total"))
    shares = types.crossJoin(F.broadcast(total)).withColumn("p", 100 * F.col("count") / F.col("total"))
    return shares.groupBy("start_meta").pivot("end_meta", [*metas, CASSETTE_END]).agg(F.sum("p")).fillna(0.0)


def meta_frequency_filter(types: DataFrame, threshold: float = 1.0, *, expected: list[str] | None = None, rescue: float = 70.0) -> DataFrame:
    """Transitions whose METAs are frequent enough.

    A META's frequency is its percent among starts and ends.  Without ``expected`` it must reach ``threshold``; with it, it
    must be expected or exceed ``rescue`` percent of the most frequent.  The ends always pass.
    """
    ends = types.select(F.explode(F.array(F.struct(F.col("start_meta").alias("m"), "count"), F.struct(F.col("end_meta").alias("m"), "count"))).alias("x")).select("x.*")
    freq = ends.where(~F.col("m").isin(CASSETTE_START, CASSETTE_END)).groupBy("m").agg(F.sum("count").alias("n"))
    stats = freq.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    f = freq.crossJoin(F.broadcast(stats))
    keep = 100 * F.col("n") / F.col("total") >= threshold if expected is None else F.col("m").isin(expected) | (100 * F.col("n") / F.col("top") > rescue)
    names = f.where(keep).select("m").unionByName(types.sparkSession.createDataFrame([(CASSETTE_START,), (CASSETTE_END,)], "m string"))
    out = types.join(names.withColumnRenamed("m", "start_meta"), "start_meta", "left_semi")
    return out.join(names.withColumnRenamed("m", "end_meta"), "end_meta", "left_semi").select(*types.columns)


def segmentation_report(segments: DataFrame, contigs: DataFrame, metas: dict[str, str], molecule: list[str], threshold: float = 0.2, assembled: DataFrame | None = None) -> DataFrame:
    """Long form ``section, key, value``: totals, pair and edge counts, heterogeneity, segments per molecule, contig lengths, META presence.

    With ``assembled`` (start_meta, end_meta, contig), the percent of each type whose contig isn't empty, and of all.
    """
    def rows(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))

    edge = (F.col("start_meta") == CASSETTE_START) | (F.col("end_meta") == CASSETTE_END)
    totals = segments.agg(F.count("*").alias("segments"), F.count_distinct(*molecule).alias("molecules"), F.sum((~edge).cast("long")).alias("consecutive"),
                          F.sum(edge.cast("long")).alias("edges"))
    out = [rows(totals, "totals", F.lit(c), F.col(c)) for c in totals.columns]
    types = segment_types(segments, molecule)
    out.append(rows(types, "transitions", F.concat_ws(">", "start_meta", "end_meta"), F.col("count")))
    het = transition_heterogeneity(segments, molecule, threshold)
    out.append(rows(het, "heterogeneity", F.concat_ws(":", "mode", F.col("n_transition_types").cast("string")), F.col("molecules")))
    per = segments.groupBy(*molecule).agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"))
    out += [rows(per, "segments_per_molecule", F.lit(c), F.col(c)) for c in per.columns]
    if assembled is not None:
        ok = 100 * F.avg((F.length(F.coalesce("contig", F.lit(""))) > 0).cast("int"))
        out.append(rows(assembled.groupBy("start_meta", "end_meta").agg(ok.alias("ok")), "assembly", F.concat_ws(">", "start_meta", "end_meta"), F.col("ok")))
        out.append(rows(assembled.agg(ok.alias("ok")), "assembly", F.lit("all"), F.col("ok")))
    n = F.length("contig")
    lengths = contigs.where(n > 0).agg(F.count("*").alias("contigs"), F.avg(n).alias("mean"), F.median(n).alias("median"))
    out += [rows(lengths, "contigs", F.lit(c), F.col(c)) for c in lengths.columns]
    out.append(rows(meta_presence(contigs, metas), "presence", F.col("feature"), F.col("percent")))
    report = out[0]
    for o in out[1:]:
        report = report.unionByName(o)
    return report


def segments_to_alleles(segments: DataFrame, positions: dict[tuple[str, str], list[tuple[str, str]]], edited: dict[str, tuple[str, str]], molecule: list[str], min_support: float = 0.5) -> DataFrame:
    """Per molecule a column for each target place: the bases between its flanks (empty: wild type, null: not found or unsupported).

    ``positions``: (start, end) -> [(column, target)].  The most frequent insertion of a molecule needs ``min_support`` of its reads.
    """
    out = []
    for (start, end), sites in positions.items():
        for site, target in sites:
            left, right = edited[target]
            ins = extract_or_null(F.col("segment_seq"), f"{left[-8:]}(.{{0,6}}?){right[:8]}", 1)
            out.append(F.struct(F.lit(start).alias("a"), F.lit(end).alias("b"), F.lit(site).alias("site"), ins.alias("ins")))
    each = segments.select(*molecule, "start_meta", "end_meta", F.explode(F.array(*out)).alias("x")).where("x.a = start_meta and x.b = end_meta and x.ins is not null")
    n = each.groupBy(*molecule, F.col("x.site").alias("site"), F.col("x.ins").alias("ins")).agg(F.count("*").alias("n"))
    top = n.groupBy(*molecule, "site").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("ins"))).alias("t"), F.sum("n").alias("all"))
    called = top.where(-F.col("t.m") >= min_support * F.col("all"))
    sites = sorted({s for v in positions.values() for s, _ in v})
    return called.groupBy(*molecule).pivot("site", sites).agg(F.first("t.ins"))
