"""UMIs: collapse, counts, correction, dominant sequences and pileup consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import hamming, hash_share
from ..sources.shared import materialise


def umi_from_mates(df: DataFrame, mates: DataFrame, read_id: str = "read_id") -> DataFrame:
    """``df`` with the ``umi`` that the mate of each read carries, by read id; reads without a mate go."""
    return df.join(mates.groupBy(read_id).agg(F.min("umi").alias("umi")), read_id)


def umi_from_tags(use_uncorrected: bool = False, corrected: tuple[str, str] = ("CB", "UB"), raw: tuple[str, str] = ("CR", "UR")) -> Column:
    """Cell and molecule tags joined: the corrected ones where both are set, else, if asked for, the raw ones; null without."""
    tags = F.concat(*corrected)  # null if either is
    return F.coalesce(tags, F.concat(*raw)) if use_uncorrected else tags


def umi_collapse(df: DataFrame, umi: Column, *, min_reads: int = 1, whitelist: DataFrame | None = None, seq: str = "seq",
                 match_pattern: str | None = None, fraction: float | None = None, read_id: str = "read_id", seed: int = 0) -> DataFrame:
    """Reads and distinct sequences of each UMI with at least ``min_reads``.

    ``umi``: a slice of the read, the tags of ``umi_from_tags``, or the column that ``umi_from_mates`` adds; reads without one go.  Reads
    must match ``match_pattern``; ``fraction`` draws that share of them by a seeded hash of ``read_id``.
    """
    if match_pattern is not None:
        df = df.where(F.col(seq).rlike(match_pattern))
    if fraction is not None:
        df = df.where(hash_share(F.col(read_id), seed) < fraction)
    keyed = df.withColumn("umi", umi).where("umi is not null")
    if whitelist is not None:
        keyed = keyed.join(whitelist.select("umi").distinct(), "umi", "left_semi")
    per_seq = keyed.groupBy("umi", F.col(seq).alias("seq")).agg(F.count("*").alias("n"))
    return per_seq.groupBy("umi").agg(F.sum("n").alias("reads"), F.count("*").alias("seqs")).where(F.col("reads") >= min_reads)


def umi_collapse_pairs(r1: DataFrame, r2: DataFrame, min_reads: int = 1) -> DataFrame:
    """The groups of both reads of a pair, each with a ``umi`` column, fused: ``umi, reads, seqs_r1, seqs_r2``; a UMI that one side lacks has 0 there."""
    both = umi_collapse(r1, F.col("umi")).select("umi", "reads", F.col("seqs").alias("seqs_r1")).join(
        umi_collapse(r2, F.col("umi")).select("umi", F.col("reads").alias("reads2"), F.col("seqs").alias("seqs_r2")), "umi", "full_outer")
    reads = F.greatest(F.coalesce("reads", F.lit(0)), F.coalesce("reads2", F.lit(0)))
    return both.select("umi", reads.alias("reads"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("seqs_r1", "seqs_r2"))).where(F.col("reads") >= min_reads)


def umi_counts(df: DataFrame, min_coverage: int = 1) -> DataFrame:
    """Reads per UMI, most first, ties by UMI descending."""
    return df.groupBy("umi").agg(F.count("*").alias("reads")).where(F.col("reads") >= min_coverage).orderBy(F.desc("reads"), F.desc("umi"))


def umi_saturation(counts: DataFrame, col: str = "reads", thresholds: tuple[int, ...] = (1, 2, 3, 4, 5, 10, 100, 1000)) -> DataFrame:
    """Number of UMIs with at least each number of reads."""
    return counts.agg(*(F.coalesce(F.sum((F.col(col) >= t).cast("long")), F.lit(0)).alias(f"umis_{t}") for t in thresholds))


def hamming_matrix(barcodes: DataFrame, col: str = "barcode") -> DataFrame:
    """Distance of every pair of distinct barcodes with their counts; pairs at distance 0 off the diagonal are dropped.

    All pairs of a stated barcode set are the result itself, so the smaller copy is broadcast by Spark if it fits.
    """
    n = barcodes.groupBy(F.col(col)).agg(F.count("*").alias("n"))
    a, b = (n.select(F.col(col).alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    return a.crossJoin(b).withColumn("distance", hamming(F.col("a"), F.col("b"))).where("a = b or distance > 0")


def hamming_correlation(matrix: DataFrame) -> DataFrame:
    """Pearson correlation of the two counts at each distance."""
    return matrix.groupBy("distance").agg(F.count("*").alias("pairs"), F.corr("n_a", "n_b").alias("r"))


def pieces(col: str, parts: int) -> Column:
    """(number, text) of ``parts`` nearly equal pieces: strings within parts - 1 substitutions share one."""
    n = F.length(col)

    def cut(i: int) -> Column:
        a = F.floor(n * i / parts).cast("int")
        return F.struct(F.lit(i).alias("k"), F.substring(col, a + 1, F.floor(n * (i + 1) / parts).cast("int") - a).alias("piece"), n.alias("n"))

    return F.array(*(cut(i) for i in range(parts)))


def _edit_pieces(col: str, parts: int) -> Column:
    """Pieces for edits: as above, without the length, so that strings of other lengths meet."""
    return F.transform(pieces(col, parts), lambda p: F.struct(p["k"].alias("k"), p["piece"].alias("piece")))


def barcode_merge(counts: DataFrame, errors: int = 1, mode: str = "dist", col: str = "umi", by: str = "reads") -> DataFrame:
    """``old, new``: each barcode's best-ranked better one within ``errors`` substitutions or (mode regex) edits; else itself.

    Rank is by count, then barcode, both descending.  With one substitution see ``_merge_of_one``; else candidates share one of errors + 1 pieces (for edits, a piece of one
    in any place of the other shifted by up to ``errors``), so no pair without a common piece is compared.
    """
    b = counts.select(F.col(col).alias("bc"), F.struct(F.col(by).alias("n"), F.col(col).alias("bc")).alias("rank"))
    if mode == "dist" and errors == 1:
        return _merge_of_one(b)
    if mode == "dist":
        left = b.select("bc", "rank", F.explode(pieces("bc", errors + 1)).alias("p"))
        right = left.select(F.col("bc").alias("new"), F.col("rank").alias("new_rank"), "p")
        near = (F.length("bc") == F.length("new")) & (hamming(F.col("bc"), F.col("new")) <= errors)
    else:
        left = b.select("bc", "rank", F.explode(_edit_pieces("bc", errors + 1)).alias("p"))
        moved = F.explode(F.flatten(F.transform(pieces("bc", errors + 1), lambda p: F.transform(
            F.sequence(F.lit(-errors), F.lit(errors)), lambda d: F.struct(p["k"].alias("k"), F.substring(
                F.col("bc"), F.greatest(F.floor(p["n"] * p["k"] / (errors + 1)).cast("int") + 1 + d, F.lit(1)), F.length(p["piece"])).alias("piece"))))))
        right = b.select(F.col("bc").alias("new"), F.col("rank").alias("new_rank"), moved.alias("p")).distinct()
        near = F.levenshtein("bc", "new", errors) >= 0
    pairs = left.join(right, "p").where((F.col("new_rank") > F.col("rank")) & near)
    best = pairs.groupBy(F.col("bc").alias("old")).agg(F.max_by("new", "new_rank").alias("new"))
    return b.select(F.col("bc").alias("old")).join(best, "old", "left").select("old", F.coalesce("new", "old").alias("new"))


def _merge_of_one(b: DataFrame) -> DataFrame:
    """``barcode_merge`` within one substitution, in proportion to the barcodes: those that agree but for one place meet under that
    place and the rest of their letters, as many as the alphabet has letters, and the best of them is the candidate of all."""
    n = F.length("bc")
    left = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.concat(F.substring("bc", F.lit(1), i - 1), F.substring("bc", i + 1, n)).alias("rest")))
    meet = b.where(n > 0).select("bc", "rank", F.explode(left).alias("p")).groupBy("p").agg(F.max("rank").alias("best"), F.collect_list("rank").alias("ranks")).where(F.size("ranks") > 1)
    found = meet.select("best", F.explode("ranks").alias("rank")).where(F.col("best") > F.col("rank"))
    best = found.groupBy(F.col("rank.bc").alias("old")).agg(F.max("best").alias("best"))
    return b.select(F.col("bc").alias("old")).join(best, "old", "left").select("old", F.coalesce("best.bc", "old").alias("new"))


def merge_roots(merge: DataFrame) -> DataFrame:
    """``old, new`` with chains followed to their end, by pointer jumping; each step is stored."""
    step = materialise(merge, "merge")
    while True:
        up = step.select(F.col("old").alias("new"), F.col("new").alias("up"))
        after = materialise(step.join(up, "new", "left").select("old", F.coalesce("up", "new").alias("new")), "merge")
        if after.join(step, ["old", "new"], "left_anti").isEmpty():
            return after
        step = after


def umi_correct(df: DataFrame, errors: int = 1, mode: str = "dist", col: str = "umi") -> DataFrame:
    """Reads with the UMI at the end of its merge chain."""
    counts = df.groupBy(col).agg(F.count("*").alias("reads"))
    roots = merge_roots(barcode_merge(counts, errors, mode, col)).withColumnsRenamed({"old": col, "new": "__new"})
    return df.join(roots, col, "left").withColumn(col, F.coalesce("__new", col)).drop("__new")


def umi_dominant_seq(df: DataFrame, keys: tuple[str, ...] = ("umi",), seq: str = "seq") -> DataFrame:
    """Per UMI the most frequent sequence (ties: the smallest), its reads, all reads, and the number of sequences."""
    n = df.groupBy(*keys, F.col(seq).alias("s")).agg(F.count("*").alias("n"))
    out = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("s").alias("s"))).alias("d"), F.sum("n").alias("reads_per_umi"), F.count("*").alias("pool_size"))
    return out.select(*keys, F.col("d.s").alias("dominant_seq"), (-F.col("d.m")).alias("dominant_reads"), "reads_per_umi", "pool_size")


def umi_coverage_table(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, umi, reads, distinct sequences, reads of the first-ranked sequence."""
    d = umi_dominant_seq(reads)
    return cells.join(d, "umi").select("cell", "umi", F.col("reads_per_umi").alias("reads"), F.col("pool_size").alias("seqs"), F.col("dominant_reads").alias("rank1_reads"))


def cell_dominant_allele(df: DataFrame, min_mol: int = 3, min_domix: float = 0.75) -> DataFrame:
    """Per cell the most frequent sequence among its UMIs, if the cell has ``min_mol`` distinct sequences and the top share reaches ``min_domix``."""
    d = umi_dominant_seq(df, ("cell",))
    share = F.col("dominant_reads") / F.col("reads_per_umi")
    return d.where((F.col("pool_size") >= min_mol) & (share >= min_domix)).select(
        "cell", F.col("dominant_seq").alias("allele"), F.col("pool_size").alias("seqs"), share.alias("share"))


def merged_unmerged_reconcile(merged: DataFrame, r1: DataFrame, r2: DataFrame) -> DataFrame:
    """UMIs in both single-end sets and not in the merged one."""
    return r1.select("umi").intersect(r2.select("umi")).join(merged.select("umi").distinct(), "umi", "left_anti")


BASES = "acgt-n"


def pileup_counts(aligned: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Per key and position (from 0) the number of each of a c g t - n."""
    each = aligned.select(key, F.posexplode(F.split(F.lower(seq), "")).alias("pos", "b")).where("b != ''")
    return each.groupBy(key, "pos").agg(*(F.sum((F.col("b") == b).cast("long")).alias({"-": "gap"}.get(b, b)) for b in BASES))


def pileup_consensus(aligned: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The majority base of each position, in order; ties go to the earlier of a c g t - n."""
    cols = [F.struct(F.col({"-": "gap"}.get(b, b)).alias("n"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(BASES)]
    top = pileup_counts(aligned, key, seq).select(key, "pos", F.array_max(F.array(*cols))["b"].alias("b"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda s: s["b"])  # a row a position of one alignment
    return top.groupBy(key).agg(F.array_join(in_order, "").alias("consensus"))

