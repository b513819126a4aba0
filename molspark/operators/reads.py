"""Reads: orientation, splitting, parsing, barcode correction and demultiplexing."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.approximate import near_ends, near_starts
from ..functions.fuzzy import Fuzzy, each_text
from ..functions.sequence import extract_or_null, fuzzy_regex, half_guard, has_fuzzy, hash_order, low_quality_bases, reverse_complement, reverse_complement_text, sanitize
from ..sources.shared import bound_batches, materialise
from .intervals import free_names


def fuzzy_sanitize(df: DataFrame, features: list[str], anchors: list[str], col: str = "seq", wildcard: str = ".{0,1}") -> DataFrame:
    """Canonical features, then anchors, in place of their fuzzy hits; features in the given order.

    With one letter or none for another, distinct texts of an Arrow batch are looked through once, where a half of a feature stands.
    """
    if wildcard == ".{0,1}":
        bound_batches(df.sparkSession)

        @F.arrow_udf("string")
        def cleaned(seqs: pa.Array) -> pa.Array:
            known = [(Fuzzy(text), text) for text in (*features, *anchors)]
            return each_text(seqs, lambda s: reduce(lambda x, f: f[0].replaced(x, f[1]), known, s), pa.string())

        return df.withColumn(col, cleaned(col))
    seq = F.col(col)
    for text in [*features, *anchors]:
        seq = sanitize(seq, text, wildcard)
        df = df.withColumn(col, seq)
        seq = F.col(col)
    return df


def approx_anchor_extract(df: DataFrame, col: str, anchor1: str, err1: int, length: int, anchor2: str, err2: int, out: str = "barcode") -> DataFrame:
    """The ``length`` bases between two anchors that may hold ``err1`` and ``err2`` edits; null without both.

    A position is the start of the barcode if the window before it is within the edits of the first anchor and the one behind it within those of
    the second; fewest edits win, then the leftmost.  One bit-vector scan an anchor leaves the positions where any stretch fits, and only their windows
    are measured.
    """
    n1, n2 = len(anchor1), len(anchor2)
    before, after, best = free_names(df, "before", "after", "best")
    s = F.col(f"`{col}`")
    df = df.withColumns({before: near_ends(s, anchor1, err1), after: near_starts(s, anchor2, err2)})
    starts = F.array_intersect(F.transform(before, lambda e: e + 1), F.transform(after, lambda b: b - length))
    inside = F.filter(starts, lambda p: (p > n1) & (p + length + n2 - 1 <= F.length(s)))
    tried = F.transform(inside, lambda p: F.struct(
        F.levenshtein(F.substring(s, p - n1, F.lit(n1)), F.lit(anchor1), err1).alias("a"),
        F.levenshtein(F.substring(s, p + length, F.lit(n2)), F.lit(anchor2), err2).alias("b"), p.alias("p")))
    fits = F.filter(tried, lambda t: (t["a"] >= 0) & (t["b"] >= 0))
    least = F.array_min(F.transform(fits, lambda t: F.struct((t["a"] + t["b"]).alias("e"), t["p"].alias("p"))))
    out_of = df.withColumn(best, least).withColumn(out, F.substring(s, F.col(f"{best}.p"), F.lit(length)))
    return out_of.withColumn("edits", F.col(f"{best}.e")).drop(before, after, best)


def quality_filter(df: DataFrame, qual_col: str, tolerance: int, min_qual: str = "@") -> DataFrame:
    """Reads with fewer than ``tolerance`` bases of quality ``min_qual`` or below."""
    return df.where(low_quality_bases(F.col(qual_col), min_qual) < tolerance)


def quality_background_quantile(df: DataFrame, qual_col: str, q: float = 0.5, first: int | None = None, order: str | None = None) -> DataFrame:
    """Per read position the quantile ``q`` of the phred values: ``pos`` from 0, ``q``; of all reads, or of the ``first`` ones by the column ``order``."""
    if first is not None:
        df = df.orderBy(order).limit(first)
    each = df.select(F.posexplode(F.split(qual_col, "")).alias("pos", "c")).where("c != ''")
    n = each.groupBy("pos", (F.ascii("c") - 33).alias("v")).agg(F.count("*").alias("n"))  # summed in the task: a row for each position and value
    return n.groupBy("pos").agg(F.percentile("v", F.lit(q), F.col("n")).alias("q"))


def quality_span_gate(df: DataFrame, bg: DataFrame, pattern: str, whitelist: DataFrame | None = None, spacer_gate: float = 0.005, ibar_gate: float = 0.009,
                      rank: float = 0.95) -> DataFrame:
    """Counts of (ibar, spacer) of reads without N that match ``pattern`` (groups 1 and 2) at good quality.

    A base is good at or above the background quantile of its position.  Reads need a share of good bases above the gates
    in both spans; pairs need a count of at least ``1 - rank`` of the largest.
    """
    hit = df.where(~F.col("seq").contains("N") & F.col("seq").rlike(pattern)).select(
        "seq", "qual", F.regexp_extract("seq", pattern, 1).alias("spacer"), F.regexp_extract("seq", pattern, 2).alias("ibar"))
    if whitelist is not None:
        hit = hit.join(whitelist.select("spacer").distinct(), "spacer", "left_semi")
    hit = hit.withColumns({"s_at": F.expr("locate(spacer, seq)"), "i_at": F.expr("locate(ibar, seq, locate(spacer, seq) + length(spacer))")})
    bg_map = bg.agg(F.map_from_entries(F.collect_list(F.struct("pos", "q"))).alias("bg"))  # a row a read position

    def share(at: str, what: str) -> Column:
        n = F.length(what)
        good = F.filter(F.sequence(F.col(at), F.col(at) + n - 1), lambda p: F.ascii(F.substring("qual", p, F.lit(1))) - 33 >= F.col("bg")[p - 1])
        return F.size(good) / n

    gated = hit.crossJoin(F.broadcast(bg_map)).withColumns({"fs": share("s_at", "spacer"), "fi": share("i_at", "ibar")})
    counts = gated.where((F.col("fs") >= spacer_gate) & (F.col("fi") >= ibar_gate)).groupBy("ibar", "spacer").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).where(F.col("n") >= (1 - rank) * F.col("top")).drop("top")


def regex_trim(df: DataFrame, pattern: str, col: str = "seq", span_index: int = 0) -> DataFrame:
    """Cut each sequence where the first match of ``pattern`` starts, or with ``span_index`` 1 where it ends; where it doesn't match, at the mean place of those that do."""
    start = F.regexp_instr(F.col(col), F.lit(pattern))
    at = F.when(start > 0, start - 1 + (F.length(F.regexp_substr(F.col(col), F.lit(pattern))) if span_index else F.lit(0)))
    mean = df.select(F.avg(at).cast("long").alias("mean_start"))
    return df.crossJoin(F.broadcast(mean)).withColumn(
        "trimmed", F.substring(F.col(col), F.lit(1), F.coalesce(at, F.col("mean_start"), F.length(col)).cast("int"))).drop("mean_start")


def keep_groups(df: DataFrame, pattern: str, col: str = "seq") -> DataFrame:
    """``trimmed``: the named groups ``(?P<name>...)`` of the first match, joined in their order; a sequence without a match stays as it is."""
    groups = sorted(re.compile(pattern).groupindex.values())
    java = re.sub(r"\(\?P<\w+>", "(", pattern)
    s = F.col(col)
    joined = F.concat(*(F.regexp_extract(s, java, g) for g in groups))
    return df.withColumn("trimmed", F.when(s.rlike(java), joined).otherwise(s))


def orient_reads(df: DataFrame, anchor: str, wildcard: str = ".{0,4}") -> DataFrame:
    """``oriented_sequence`` and ``oriented_quality``: as is if the anchor matches, else reversed if its reverse complement does.

    The reverse complement of a read holds the anchor where the read holds the anchor's reverse complement, so only
    reads that turn around are reversed.
    """
    s = F.col("sequence")
    flipped = df.withColumn("__flip", ~has_fuzzy(s, anchor, wildcard) & has_fuzzy(s, reverse_complement_text(anchor), wildcard))
    return flipped.withColumns({"oriented_sequence": F.when(F.col("__flip"), reverse_complement(s)).otherwise(s),
                                "oriented_quality": F.when(F.col("__flip"), F.reverse("quality_scores")).otherwise(F.col("quality_scores"))}).drop("__flip")


def ont_to_paired(df: DataFrame, umi_len: int, sbc_len: int, anchor_orient: str, anchor_ont: str, *, modality: str = "single-molecule", cbc_len: int = 16,
                  wildcard: str = ".{0,4}", do_rev_comp: bool = False) -> DataFrame:
    """Long reads as pairs: oriented, cut behind the last fuzzy adapter, then split at the length of barcodes and anchor."""
    head = (cbc_len + umi_len if modality == "single-cell" else umi_len + sbc_len) + len(anchor_ont)
    out = orient_reads(df, anchor_orient, wildcard)
    s, q = F.col("oriented_sequence"), F.col("oriented_quality")
    pattern = f"^.*(?:{fuzzy_regex(anchor_orient, wildcard)})(.*)$"

    def behind(x: Column) -> Column:
        """What follows the last adapter; an empty rest is told from no adapter by a second look, which few rows need."""
        rest = F.regexp_extract(x, pattern, 1)
        return F.when(half_guard(x, anchor_orient), F.transform(F.array(rest), lambda r: F.when((r != "") | x.rlike(pattern), r))[0])

    out = out.withColumn("after", behind(s))
    out = out.withColumn("trim_pos", F.length(s) - F.length("after"))
    out = out.withColumns({"ts": F.coalesce("after", s), "tq": F.when(F.col("trim_pos").isNotNull(), F.substring(q, F.col("trim_pos") + 1, F.length(q))).otherwise(q)})
    rest_s, rest_q = F.expr(f"substr(ts, {head + 1})"), F.expr(f"substr(tq, {head + 1})")
    return out.select(F.col("name").alias("read_id"), F.substring("ts", 1, head).alias("r1_seq"), F.substring("tq", 1, head).alias("r1_qual"),
                      (reverse_complement(rest_s) if do_rev_comp else rest_s).alias("r2_seq"), (F.reverse(rest_q) if do_rev_comp else rest_q).alias("r2_qual"), "trim_pos")


def parse_barcodes(df: DataFrame, umi_len: int, anchor: str, sbc_len: int = 6, *, modality: str = "single-molecule", cbc_len: int = 16, open_end: bool = False) -> DataFrame:
    """Barcodes of read 1, on-target flag and validity of each row by itself, for batches and streams.

    ``valid_umi``: what precedes the anchor has the length of the barcodes; the anchor must end read 1 unless ``open_end``.
    """
    r1 = F.col("r1_seq")
    if modality == "single-cell":
        df = df.withColumns({"cbc": F.substring(r1, 1, cbc_len), "umi_only": F.substring(r1, cbc_len + 1, umi_len), "sbc": F.lit("")})
        df, expected = df.withColumn("umi", F.concat("cbc", "umi_only")), cbc_len + umi_len
    else:
        first, second = ("sbc", "umi") if modality == "single-molecule-v2" else ("umi", "sbc")
        n = {"umi": umi_len, "sbc": sbc_len}
        df, expected = df.withColumns({first: F.substring(r1, 1, n[first]), second: F.substring(r1, n[first] + 1, n[second])}), umi_len + sbc_len
    prefix = F.length(F.regexp_extract(r1, f"(.*?){anchor}{'.*' if open_end else ''}$", 1))
    return df.withColumns({"ont": r1.rlike(anchor), "valid_umi": prefix == expected})


def parse_reads(df: DataFrame, umi_len: int, anchor: str, sbc_len: int = 6, **options) -> DataFrame:
    """``parse_barcodes`` with frame-level metrics and reads per UMI.

    The four metrics are one broadcast row; reads per UMI are counted with a partial aggregate and joined back, so a
    UMI with very many reads is never held in one task.
    """
    df = parse_barcodes(df, umi_len, anchor, sbc_len, **options)
    ont = F.col("ont").cast("int")
    metrics = df.agg(F.sum(ont).alias("metric_reads_ont"), F.sum(1 - ont).alias("metric_reads_offt"),
                     F.avg(ont).alias("metric_fraction_ont"), F.avg(1 - ont).alias("metric_fraction_offt"))
    per_umi = df.groupBy("umi").agg(F.count("*").alias("reads"))
    return df.crossJoin(F.broadcast(metrics)).join(per_umi, "umi")


def parse_read1(df: DataFrame, anchor: str) -> DataFrame:
    """``df`` and the inserts that stand behind the anchor in a long read 1, as rows of their own."""
    own = df.withColumn("r2_seq", extract_or_null(F.col("r1_seq"), f".*?{anchor}(.*)$", 1)).where("r2_seq is not null and r2_seq != ''")
    return df.unionByName(own)


def preprocess_split(df: DataFrame, sample_id: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) reads, tagged with the sample."""
    tagged = df.withColumn("sample_id", F.lit(sample_id))
    ok = F.coalesce(F.col("valid_umi") & F.col("ont"), F.lit(False))
    return tagged.where(ok), tagged.where(~ok)


def preprocess_metrics(df: DataFrame) -> DataFrame:
    """One row: shares and numbers of valid UMIs over distinct (umi, valid_umi), and the read metrics."""
    v = F.col("valid_umi").cast("int")
    umis = df.select("umi", "valid_umi").distinct().agg(F.avg(v).alias("fraction_valid_umis"), F.sum(v).alias("n_valid_umis"), F.sum(1 - v).alias("n_invalid_umis"))
    reads = df.agg(*(F.max(c).alias(c) for c in df.columns if c.startswith("metric_")))
    return umis.crossJoin(F.broadcast(reads))


def read_umi_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_reads"), F.countDistinct("umi").alias("total_umis"))


def correction_pairs(df: DataFrame, raw: str, corrected: str) -> DataFrame:
    """Distinct raw -> corrected barcodes, the lane suffix stripped, where both are set."""
    return df.where(F.col(raw).isNotNull() & F.col(corrected).isNotNull()).select(F.col(raw).alias("raw"), F.regexp_replace(corrected, "-1$", "").alias("corrected")).distinct()


def correct_barcodes(df: DataFrame, pairs: DataFrame, col: str = "cbc") -> DataFrame:
    """``col`` replaced by its corrected form where there is one; ``matched`` says whether there was."""
    one = pairs.groupBy(F.col("raw").alias(col)).agg(F.min("corrected").alias("__new"))
    return df.join(one, col, "left").withColumn("matched", F.col("__new").isNotNull()).withColumn(col, F.coalesce("__new", col)).drop("__new")


def correction_report(corrected: DataFrame, col: str = "cbc") -> DataFrame:
    """What ``correct_barcodes`` matched: a row ``matched`` with the share of reads in ``fraction``, and a row for each barcode it missed with its reads."""
    total = corrected.agg(F.count("*").alias("all"), F.avg(F.col("matched").cast("int")).alias("share"), F.sum(F.col("matched").cast("long")).alias("n"))
    one = total.select(F.lit("matched").alias("case"), F.lit(None).cast("string").alias(col), F.coalesce("n", F.lit(0)).alias("reads"), "share")
    missed = corrected.where("not matched").groupBy(col).agg(F.count("*").alias("reads")).crossJoin(F.broadcast(total.select("all")))
    return one.unionByName(missed.select(F.lit("missed").alias("case"), col, "reads", (F.col("reads") / F.col("all")).alias("share"))).withColumnRenamed("share", "fraction")


def cells_from_umis(df: DataFrame, pairs: DataFrame | None = None, cell_len: int = 16) -> DataFrame:
    """``cell`` of each compound UMI: corrected if a map is given, else as is with ``-1`` unless it holds an N."""
    out = df.select(F.substring("umi", 1, cell_len).alias("raw"), "umi").distinct()
    if pairs is None:
        return out.where("raw not like '%N%'").select(F.concat("raw", F.lit("-1")).alias("cell"), "umi")
    return out.join(pairs, "raw").select(F.col("corrected").alias("cell"), "umi")


def demux_by_suffix(df: DataFrame, sheet: DataFrame, suffix_len: int) -> DataFrame:
    """UMIs per sample by the last bases; those not on the sheet are undetermined."""
    named = df.withColumn("bc", F.right("umi", F.lit(suffix_len))).join(sheet, "bc", "left")
    return named.groupBy(F.coalesce("name", F.lit("undetermined")).alias("sample")).agg(F.count("*").alias("umis"))


def demux_by_index(df: DataFrame, samples: DataFrame, anchor: str, index_len: int = 6, wildcard: str = ".{0,1}") -> DataFrame:
    """``sample_id`` (null: invalid) of pairs whose index is listed and whose read 1 holds the anchor."""
    named = df.withColumn("index", F.substring("r2_seq", 1, index_len)).join(samples, "index", "left")
    ok = F.col("sample_id").isNotNull() & has_fuzzy(F.col("r1_seq"), anchor, wildcard)
    return named.withColumn("sample_id", F.when(ok, F.col("sample_id")))


def split_by_tag(df: DataFrame, groups: DataFrame, tag: str) -> DataFrame:
    """Rows with the annotation group of their tag, ``undet`` where there is none."""
    return df.join(groups, tag, "left").withColumn("grp", F.coalesce("grp", F.lit("undet")))


def tag_read_ids(df: DataFrame, umi_len: int) -> DataFrame:
    """Read ids that carry the UMI of read 1, and the UMI read back from them."""
    tagged = F.concat("read_id", F.lit(":umi:"), F.substring("r1_seq", 1, umi_len))
    return df.select(tagged.alias("read_id"), "r2_seq").withColumn("umi", F.regexp_extract("read_id", ":umi:([A-Z]+)$", 1))


def ingest_experiments(frames: list[DataFrame], batches: DataFrame, valid_cells: DataFrame | None, min_mols: int) -> DataFrame:
    """Molecules of all experiments with their batch; cells get it as suffix; barcodes need ``min_mols`` molecules.

    Samples and batches must be 1:1; a sample listed twice, or a batch of two samples, is an error.  Batches, valid cells and frequent barcodes are
    stored, so Spark knows their sizes and broadcasts small ones: molecules are not shuffled to a task a sample.
    """
    pairs = materialise(batches.select("sample_id", "batch").distinct(), "batches")
    if bad := [r[0] for c in ("sample_id", "batch") for r in pairs.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c).limit(10).collect()]:
        raise ValueError(f"samples and batches are not 1:1: {bad}")
    batches = pairs
    allm = frames[0]
    for f in frames[1:]:
        allm = allm.unionByName(f)
    allm = allm.join(batches, "sample_id").withColumn("cbc", F.concat_ws("-", "cbc", "batch"))
    if valid_cells is not None:
        allm = allm.join(materialise(valid_cells.select("cbc").distinct(), "cells"), "cbc", "left_semi")
    enough = materialise(allm.groupBy("raw_ibar").agg(F.count("*").alias("n")).where(F.col("n") >= min_mols).select("raw_ibar"), "barcodes")
    return allm.join(enough, "raw_ibar", "left_semi")


def downsample_per_group(df: DataFrame, n: int, over: list[str], key: str, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group, chosen by a seeded hash of ``key``, ties by all columns (a sampling operator)."""
    w = Window.partitionBy(*over).orderBy(hash_order(seed, F.col(key)), key, *(c for c in df.columns if c != key))
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def head_per_file(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by ``order`` of each input file, with the file's name; ``df`` is read from files."""
    named = df.withColumn("file", F.input_file_name())
    w = Window.partitionBy("file").orderBy(order)
    return named.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def downsample_by_coverage(df: DataFrame, umis_per_group: int = 30, seed: int = 0) -> DataFrame:
    """All reads of up to ``umis_per_group`` UMIs around the 10, 50 and 90 % quantiles of reads per UMI."""
    counts = df.groupBy("umi").agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile("n", F.array(*(F.lit(x) for x in (0.1, 0.49, 0.5, 0.52, 0.9)))).alias("q"))
    n, q = F.col("n"), F.col("q")
    binned = counts.crossJoin(F.broadcast(cuts)).withColumn("bin", F.when(n <= q[0], "10%").when((n > q[1]) & (n <= q[3]) | (n == q[2]), "50%").when(n >= q[4], "90%"))
    return df.join(downsample_per_group(binned.where("bin is not null").select("umi", "bin"), umis_per_group, ["bin"], "umi", seed), "umi")
