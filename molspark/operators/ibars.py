"""Single-guide molecules: encoding, collapse, whitelists, annotation, QC and clones."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import Fuzzy, compiled, each_text
from ..functions.sequence import fuzzy_pattern, fuzzy_regex
from ..sources.shared import bound_batches, materialise
from .dictionaries import ENTRY_BYTES, MAP_BYTES
from .intervals import free_names
from .pairs import pairs_in_groups
from .ranks import global_rank
from .umi import barcode_merge, merge_roots

# The guide's features.
TSO, U6, BROKEN_U6 = "TTTCTTATATGGG", "GACGAAACACC", "GGAAAGAAACACCG"
DOWNSTREAM, CANONICAL, PRIMER, SCAFFOLD2 = "AATAGCAA", "GGGTTAGAG", "GGCTAGTCCGTTATCAACTTG", "GTTAACCTAA"
STAMMER = "TATGGGTATGGG"


def encode_rules(zombie: bool = False, f: Callable[[str], str] = fuzzy_pattern) -> list[tuple[str, str, str]]:
    """(pattern, token, feature or token without which the pattern can't match) in the order in which they apply.

    The barcode is read after the third.
    """
    scf1, scf2, u6 = (rf"\[···{x}···\]" for x in ("SCF1", "SCF2", "U6"))
    return [
        (f".*?({f(TSO)})", "[···TSO···]", TSO), (f".*({f(U6)})", "[···U6···]", U6), (f".*({f(BROKEN_U6)})", "[···bU6···]", BROKEN_U6),
        (f"({f(DOWNSTREAM)})", "[···SCF1···]", DOWNSTREAM), (f"({f(SCAFFOLD2)})", "[···SCF2···]", SCAFFOLD2), (f"({CANONICAL})", "[···CNSCFL···]", CANONICAL),
        (f"({f(PRIMER)})", "[···LIB···]", PRIMER), (scf2 + r".+\[···LIB···\]", "[···SCF2···][···LIB···]", "SCF2"), (scf2 + r"\[···LIB···\].+$", "", "SCF2"),
        (f(STAMMER), "[XXX]", STAMMER), *([] if zombie else [(u6, "[···TSO···]", "U6")]), (scf1 + scf2 + ".*", "[···SCF1···]", "SCF2"),
    ]


RAW_IBAR = f"CTAGA(.{{6}})({fuzzy_pattern(DOWNSTREAM)})"
WT_PATTERN = r"\[···WT···\]\[···CNSCFL···\]"


def _encoder(zombie: bool) -> Callable[[str], tuple[str, str | None]]:
    """The rules as a function of one text: encoded, and the barcode."""
    steps: list[Callable[[str], str]] = []
    for pattern, token, needs in encode_rules(zombie, lambda text: f"<{text}>"):
        fuzzy = re.fullmatch(r"(\.\*\??)?\(?<(\w+)>\)?", pattern)
        if not fuzzy:
            plain = compiled(pattern)
            steps.append(lambda s, p=plain, t=token, n=needs: p.sub(t, s) if n in s else s)
        elif fuzzy[1]:
            steps.append(partial(Fuzzy(fuzzy[2]).cut_to, token=token, last=fuzzy[1] == ".*"))
        else:
            steps.append(partial(Fuzzy(fuzzy[2]).replaced, token=token))
    barcode = compiled(f"CTAGA(.{{6}})(?:{fuzzy_regex(DOWNSTREAM)})")

    def encode(s: str) -> tuple[str, str | None]:
        for step in steps[:3]:
            s = step(s)
        raw = barcode.search(s)
        for step in steps[3:]:
            s = step(s)
        return s, raw and raw[1]

    return encode


_CODED = pa.struct([("seq", pa.string()), ("raw_ibar", pa.string())])


def encode_reads(df: DataFrame, zombie: bool = False) -> DataFrame:
    """``seq`` with tokens for known features, ``oseq`` as it was, ``raw_ibar`` (null if there is none) and ``wt``.

    Rows go to Python in Arrow batches, of which each distinct text is encoded once; a feature is looked for where one of its halves stands.
    """
    bound_batches(df.sparkSession)

    @F.arrow_udf("seq string, raw_ibar string")
    def encoded(seqs: pa.Array) -> pa.Array:
        encode = _encoder(zombie)
        return each_text(seqs, lambda s: dict(zip(("seq", "raw_ibar"), encode(s), strict=True)), _CODED)

    (coded,) = free_names(df, "coded")
    out = df.withColumn(coded, encoded("seq")).withColumns({"oseq": F.col("seq"), "raw_ibar": F.col(coded)["raw_ibar"]})
    return mask_wt(out.withColumn("seq", F.col(coded)["seq"]).drop(coded))


def spacer_hits(seqs: DataFrame, spacers: DataFrame) -> DataFrame:
    """``seq, hits`` of each distinct ``seq`` that holds a spacer: places (from 1) and spacers in the order of place, then of the spacer's text.

    Each place of a sequence is looked up by a join on what stands there, once for each length that spacers have; so the whitelist may have any
    number of rows, and Spark broadcasts it only where it is small.
    """
    listed = spacers.select(F.col("spacer").alias("hit")).where("hit <> ''").distinct()
    lengths = listed.groupBy(F.length("hit").alias("size")).agg(F.count("*").alias("listed"))  # a row a length
    places = seqs.select("seq").where("seq is not null").distinct().crossJoin(lengths.select("size")).where("length(seq) >= size")
    places = places.select("seq", F.explode(F.expr("sequence(1, length(seq) - size + 1)")).alias("at"), "size").withColumn("hit", F.expr("substring(seq, at, size)"))
    return places.join(listed, "hit").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("at", "hit"))).alias("hits"))


def with_hits(df: DataFrame, spacers: DataFrame, out: str, map_bytes: int | None = None) -> DataFrame:
    """``df`` with ``out``, the ``hits`` of ``seq`` as ``spacer_hits`` has them; null or empty without one.

    The whitelist is stored and measured: up to ``map_bytes`` every task looks the places of its rows up in it, with no shuffle; a larger one is joined.
    """
    listed = materialise(spacers.select("spacer").where("spacer <> ''").distinct(), "spacers")
    size = listed.agg(F.sum(F.octet_length("spacer") + ENTRY_BYTES)).first()[0] or 0
    if size > (MAP_BYTES if map_bytes is None else map_bytes):
        return df.join(spacer_hits(df, listed).withColumnRenamed("hits", out), "seq", "left").select(*df.columns, out)
    bound_batches(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in listed.collect()))
    lengths = sorted({len(x) for x in known.value})

    @F.arrow_udf("array<struct<at:int,hit:string>>")
    def hits(seqs: pa.Array) -> pa.Array:
        some = known.value

        def found(s: str) -> list[dict]:
            places = [(at, size) for size in lengths for at in range(len(s) - size + 1) if s[at : at + size] in some]
            return [{"at": at + 1, "hit": s[at : at + size]} for at, size in sorted(places)]

        return each_text(seqs, found, pa.list_(pa.struct([("at", pa.int32()), ("hit", pa.string())])))

    return df.withColumn(out, hits("seq"))


def _coded(hits: str) -> Column:
    """``seq`` with a token for each of the ``hits`` from the left that begin behind the last one's end."""
    def step(acc: Column, h: Column) -> Column:
        return F.when(h["at"] < acc["next"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substring(F.col("seq"), acc["next"], h["at"] - acc["next"]), F.lit("[···WT···]")).alias("out"), (h["at"] + F.length(h["hit"])).alias("next")))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    coded = F.aggregate(hits, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("seq"), acc["next"], F.length("seq"))))
    return F.when(F.size(hits) > 0, coded).otherwise(F.col("seq"))


def _first_spacer(hits: str) -> Column:
    rest = F.regexp_replace(F.regexp_replace("seq", "CTAGA.+?$", ""), r"\[···(TSO|CNSCFL|bU6)···\]", "")
    return F.coalesce(F.get(hits, F.lit(0))["hit"], rest)


def encode_wt(df: DataFrame, spacers: DataFrame, map_bytes: int | None = None) -> DataFrame:
    """Whole spacers of a whitelist (``spacer``) as a token: from the left, of those that begin at one place the first in the order of their texts."""
    (hits,) = free_names(df, "hits")
    return with_hits(df, spacers, hits, map_bytes).withColumn("seq", _coded(hits)).select(*df.columns)


def mask_wt(df: DataFrame) -> DataFrame:
    """``wt``: exactly one spacer token, and the canonical scaffold right behind it."""
    s = F.col("seq")
    return df.withColumn("wt", s.contains("WT") & (F.regexp_count(s, F.lit("WT")) == 1) & s.rlike(WT_PATTERN))


def ibar_molecules(reads: DataFrame, modality: str = "single-cell") -> DataFrame:
    """Molecules: reads, reads of the most frequent sequence, that sequence and its original; tied ones are dropped.

    Reads are shuffled and sorted once, by molecule; both aggregations pass over them in that order and hold a few texts.
    """
    keys = ["cbc", "umi", "raw_ibar"] if modality == "single-cell" else ["umi", "raw_ibar"]
    n = reads.where("raw_ibar is not null").select(*keys, "seq", "oseq").repartition(*keys).groupBy(*keys, "seq").agg(F.count("*").alias("n"), F.min("oseq").alias("oseq"))
    top = n.groupBy(*keys).agg(F.sum("n").alias("umi_reads"), F.max("n").alias("umi_dom_reads"), F.max(F.struct("n", "seq", "oseq")).alias("b"),
                               F.min(F.struct((-F.col("n")).alias("m"), "seq")).alias("low"))
    alone = F.col("low.seq").eqNullSafe(F.col("b.seq"))  # of the most frequent ones the first and the last by text
    return top.where(alone).select(*keys, "umi_reads", "umi_dom_reads", "b.seq", "b.oseq")


def extract_spacer(df: DataFrame, spacers: DataFrame, map_bytes: int | None = None) -> DataFrame:
    """``spacer``: the first of a whitelist (``spacer``) in the encoded sequence, else what stands before CTAGA without tokens."""
    (hits,) = free_names(df, "hits")
    return with_hits(df, spacers, hits, map_bytes).withColumn("spacer", _first_spacer(hits)).drop(hits)


COUNTED = {"np_tsos": "TSO", "np_dss": "SCF1", "np_sts": "XXX", "np_u6s": "·U6·", "np_bu6s": "bU6", "np_can": "CNSCFL", "np_wts": "WT"}


def pattern_counts(df: DataFrame) -> DataFrame:
    """How often each token stands in the encoded sequence."""
    return df.withColumns({c: F.regexp_count("seq", F.lit(p)) for c, p in COUNTED.items()})


def noise_spectrum(df: DataFrame, index: str, column: str, values: list[int]) -> DataFrame:
    """Molecules by two pattern counts, in percent of all."""
    total = df.agg(F.count("*").alias("total"))
    n = df.groupBy(index).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)
    return n.crossJoin(F.broadcast(total)).select(index, *(F.round(100 * F.col(str(v)) / F.col("total"), 9).alias(f"{column}_{v}") for v in values))


def with_counts(df: DataFrame, keys: list[str], name: str, what: Column | None = None) -> DataFrame:
    """A count (or distinct count) over keys joined to every row: aggregated first, so no group is held in a window."""
    n = df.groupBy(*keys).agg((F.count("*") if what is None else F.countDistinct(what)).alias(name))
    return df.join(n, keys)


def reads_to_molecules(reads: DataFrame, spacers: DataFrame, modality: str = "single-cell", min_reads: int = 1, max_reads: int = 1 << 30) -> DataFrame:
    """Reads to molecules with spacer, uncut flag, UMIs per allele and sibling alleles."""
    m = ibar_molecules(encode_reads(reads), modality)
    (hits,) = free_names(m, "hits")
    m = mask_wt(with_hits(m, spacers, hits).withColumn("spacer", _first_spacer(hits)).withColumn("seq", _coded(hits)).drop(hits))
    for c in ("raw_ibar", "spacer", "umi"):
        m = m.where(~F.col(c).contains("N"))
    m = materialise(m.where(F.col("umi_dom_reads").between(min_reads, max_reads)), "molecules")
    keys = ["cbc", "raw_ibar"] if modality == "single-cell" else ["raw_ibar"]
    alleles = m.groupBy(*keys, "seq").agg(F.count("umi").alias("umis_allele"))  # a UMI stands once in a cell and barcode
    counts = materialise(alleles.join(alleles.groupBy(*keys).agg(F.count("seq").alias("n_sib")), keys), "alleles")
    return m.join(counts, [*keys, "seq"])


def valid_ibars(df: DataFrame, min_cells: float, min_mols: int, errors: int = 1, fraction: bool = False) -> DataFrame:
    """Barcodes without N in more than ``min_cells`` cells and ``min_mols`` molecules that no better one within ``errors`` absorbs.

    With ``fraction``, ``min_cells`` is a share of all cells.
    """
    n = df.groupBy("raw_ibar").agg(F.countDistinct("cbc").alias("cells"), F.count("*").alias("mols"))
    least = F.lit(min_cells)
    if fraction:
        n = n.crossJoin(F.broadcast(df.agg(F.countDistinct("cbc").alias("all_cells"))))
        least = F.lit(float(min_cells)) * F.col("all_cells")
    some = n.where((F.col("cells") > least) & (F.col("mols") > min_mols) & ~F.col("raw_ibar").contains("N")).drop("all_cells")
    own = barcode_merge(some, errors, "dist", "raw_ibar", "mols").where("old = new").select(F.col("old").alias("raw_ibar"))
    return some.join(own, "raw_ibar", "left_semi")


def mask_valid_ibars(df: DataFrame, valid: DataFrame) -> DataFrame:
    marked = valid.select("raw_ibar", F.lit(True).alias("valid_ibar"))
    return df.join(marked, "raw_ibar", "left").withColumn("valid_ibar", F.coalesce("valid_ibar", F.lit(False)))


def prefixed_ibar(df: DataFrame, first: int, length: int, min_molecules: int) -> DataFrame:
    """Uncut molecules by barcode and a part of the spacer, those with more than ``min_molecules``."""
    name = F.concat_ws(".", "raw_ibar", F.substring("spacer", first, length))
    return df.where("wt").groupBy(name.alias("pibar")).agg(F.count("*").alias("mols")).where(F.col("mols") > min_molecules)


def umi_coverage_filter(df: DataFrame, min_cov: int | None = None, quantile: float | None = None) -> DataFrame:
    """Reads of UMIs with ``min_cov`` reads, or at least the quantile of reads per UMI."""
    n = df.groupBy("umi").agg(F.count("*").alias("n"))
    if quantile is not None:
        cut = n.agg(F.percentile("n", F.lit(quantile)).alias("cut"))
        n = n.crossJoin(F.broadcast(cut)).where("n >= cut")
    else:
        n = n.where(F.col("n") >= min_cov)
    return df.join(n.select("umi"), "umi", "left_semi")


def molecule_consensus_split(reads: DataFrame, whitelist: DataFrame, anchor: str) -> DataFrame:
    """Per cell, barcode and UMI the dominant read behind the anchor, as expected, unexpected or no_ibar."""
    cut = reads.withColumn("seq", F.when(F.instr("seq", anchor) > 0, F.expr(f"substr(seq, instr(seq, '{anchor}'))")).otherwise(F.col("seq")))
    n = cut.groupBy("cbc", "raw_ibar", "umi", "seq").agg(F.count("*").alias("n"))
    top = n.groupBy("cbc", "raw_ibar", "umi").agg(F.min(F.struct((-F.col("n")).alias("m"), "seq")).alias("b"), F.sum("n").alias("reads"))
    known = whitelist.select("raw_ibar", F.lit(True).alias("known")).distinct()
    label = F.when(F.col("raw_ibar").isNull(), "no_ibar").when(F.col("known"), "expected").otherwise("unexpected")
    return top.join(known, "raw_ibar", "left").select("cbc", "raw_ibar", "umi", F.col("b.seq").alias("seq"), "reads", label.alias("label"))


def annotate_ibars(mols: DataFrame, meta: DataFrame, quantile: float = 0.55, top: int = 2) -> DataFrame:
    """Top spacers of each barcode above the quantile of their counts, with metadata: ``raw_ibar, spacer, n, rank`` and meta columns."""
    n = mols.groupBy("raw_ibar", "spacer").agg(F.count("*").alias("n"))
    cut = n.agg(F.percentile("n", F.lit(quantile)).alias("cut"))
    w = Window.partitionBy("raw_ibar").orderBy(F.desc("n"), "spacer")
    return n.crossJoin(F.broadcast(cut)).where("n >= cut").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("cut").join(meta, "raw_ibar", "left")


def allele_diversity(mols: DataFrame) -> DataFrame:
    """Distinct sequences and spacers of each (sample, cell, barcode)."""
    return mols.groupBy("sample_id", "cbc", "raw_ibar").agg(F.countDistinct("seq").alias("n_seq"), F.countDistinct("spacer").alias("n_spacer"))


def empirical_annotation(mols: DataFrame, meta: DataFrame, top_n: int = 1) -> DataFrame:
    """Top spacers of each (sample, barcode) by dense rank, their count per 10,000 of the sample's kept ones, and metadata by spacer."""
    n = mols.groupBy("sample_id", "raw_ibar", "spacer").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample_id", "raw_ibar").orderBy(F.desc("n"))
    kept = n.withColumn("k", F.dense_rank().over(w)).where(F.col("k") <= top_n).drop("k")
    total = kept.groupBy("sample_id").agg(F.sum("n").alias("total"))
    return kept.join(total, "sample_id").withColumn("nlen", 1e4 * F.col("n") / F.col("total")).drop("total").join(meta, "spacer")


def ibar_qc(mols: DataFrame) -> DataFrame:
    """Reads and UMIs of each (sample, barcode), over all samples, and their shares.

    ``ibar_umisg`` sums the distinct per-sample counts: two samples with equal counts count once.
    """
    per = mols.groupBy("sample_id", "raw_ibar").agg(F.sum("umi_reads").alias("ibar_reads"), F.countDistinct("umi").alias("ibar_umis"))
    over = per.groupBy("raw_ibar").agg(F.sum_distinct("ibar_reads").alias("ibar_readsg"), F.sum_distinct("ibar_umis").alias("ibar_umisg"))
    sample = per.groupBy("sample_id").agg(F.sum("ibar_umis").alias("sample_umis"))
    share = F.col("ibar_umis") / F.col("sample_umis")
    return per.join(over, "raw_ibar").join(sample, "sample_id").withColumns({"log_umis": F.log10("ibar_umis"), "umi_share": share, "neg_log_share": -F.log10(share)}).drop("sample_umis")


def ibar_filter(df: DataFrame, min_global: int = 0, min_sample: int = 0, whitelist: DataFrame | None = None) -> DataFrame:
    out = df.where((F.col("ibar_umisg") >= min_global) & (F.col("ibar_umis") >= min_sample))
    return out if whitelist is None else out.join(whitelist.select("raw_ibar").distinct(), "raw_ibar", "left_semi")


def ibar_screen(mols: DataFrame, clusters: DataFrame, top_n: int = 10) -> DataFrame:
    """Molecules of barcodes by cluster (unknown where none is listed), those of the first ``top_n`` dense ranks."""
    n = mols.join(clusters, "raw_ibar", "left").withColumn("clone", F.coalesce("clone", F.lit("unknown"))).groupBy("clone", "raw_ibar").agg(F.count("*").alias("mols"))
    w = Window.partitionBy("clone").orderBy(F.desc("mols"))
    return n.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= top_n)


def stacked_fractions(mols: DataFrame, groups: list[str], n_top: int) -> DataFrame:
    """Top alleles of each group with their frequency among the group's molecules and the running offset below them."""
    n = mols.groupBy(*groups, "seq").agg(F.count("*").alias("n"))
    total = n.groupBy(*groups).agg(F.sum("n").alias("total"))
    w = Window.partitionBy(*groups).orderBy(F.desc("n"), "seq")
    top = n.join(total, groups).withColumns({"k": F.row_number().over(w), "freq": F.col("n") / F.col("total")}).where(F.col("k") <= n_top)
    before = Window.partitionBy(*groups).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return top.withColumn("offset", F.coalesce(F.sum("freq").over(before), F.lit(0.0))).drop("total")


def qc_stats_by_sample(mols: DataFrame, meta: DataFrame) -> DataFrame:
    """Long QC rows: ``sample_id, label, metric, value``."""
    q = mols.groupBy("sample_id").agg(F.count("*").cast("double").alias("molecules"), F.countDistinct("umi").cast("double").alias("umis"), F.countDistinct("cbc").cast("double").alias("cells"),
                                      F.avg("umi_reads").alias("reads_per_umi"))
    return q.join(meta, "sample_id", "left").unpivot(["sample_id", "label"], ["molecules", "umis", "cells", "reads_per_umi"], "metric", "value")


def sibling_noise(mols: DataFrame) -> DataFrame:
    """UMIs of each (cell, barcode, sequence), sibling sequences of its (cell, barcode), and whether it is the top one."""
    n = mols.groupBy("cbc", "raw_ibar", "seq").agg(F.countDistinct("umi").alias("umis"))
    s = n.groupBy("cbc", "raw_ibar").agg(F.count("*").alias("siblings"), F.max(F.struct("umis", "seq")).alias("b"))
    return n.join(s, ["cbc", "raw_ibar"]).select("cbc", "raw_ibar", "seq", "umis", "siblings", (F.col("seq") == F.col("b.seq")).alias("is_top"))


def allele_calling(mols: DataFrame, excluded: str = "doublet_prediction") -> DataFrame:
    """Per (cell, barcode) the top allele by molecules and by normalised counts, ties, siblings and read maxima.

    ``ties``: molecules of alleles at the maximum over the maximum, less one.  Ties go to the greater sequence.
    """
    per = mols.groupBy(excluded, "cbc", "raw_ibar", "seq").agg(F.count("*").alias("n"), F.max("norm_counts").alias("norm"), F.max("umi_reads").alias("r"), F.max("umi_dom_reads").alias("d"))
    out = per.groupBy(excluded, "cbc", "raw_ibar").agg(
        F.sum("n").alias("umis_per_ibar"), F.max("n").alias("umis_top_allele"), F.count("*").alias("siblings"), F.max("norm").alias("norm_counts"),
        F.max_by("seq", F.struct("n", "seq")).alias("top_allele_raw"), F.max_by("seq", F.struct("norm", "seq")).alias("top_allele_norm"),
        F.max("d").alias("umi_dom_reads"), F.max("r").alias("umi_reads"))
    at_max = per.join(out.select(excluded, "cbc", "raw_ibar", "umis_top_allele"), [excluded, "cbc", "raw_ibar"]).where("n = umis_top_allele").groupBy(excluded, "cbc", "raw_ibar").agg((F.count("*") - 1).cast("double").alias("ties"))
    return out.join(at_max, [excluded, "cbc", "raw_ibar"])


def normalize_mols(mols: DataFrame, min_umis: int = 0) -> DataFrame:
    """Singlets with the weight of their allele: its molecules times the share of the cell times the share of the barcode."""
    s = mols.where("doublet_prediction = 'singlet'")
    total = s.agg(F.count("*").alias("total_umis"))
    out = with_counts(with_counts(with_counts(s, ["cbc"], "umis_per_cell"), ["raw_ibar"], "total_umis_ibar"), ["cbc", "raw_ibar", "seq"], "umis_allele")
    out = out.where(F.col("umis_per_cell") >= min_umis).crossJoin(F.broadcast(total))
    joint = F.col("umis_per_cell") / F.col("total_umis") * (F.col("total_umis_ibar") / F.col("total_umis"))
    return out.withColumn("weighted_counts", F.col("umis_allele") * joint)


def clonal_composition(mols: DataFrame, clusters: list[int]) -> DataFrame:
    """Cell by cluster molecule counts as ``ibc_{cluster}``."""
    wide = mols.groupBy("cbc").pivot("cluster", clusters).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumnsRenamed({str(c): f"ibc_{c}" for c in clusters})


def clone_scores(mols: DataFrame, a: int = 1, b: int = 2) -> DataFrame:
    """Singlet cells with log10 ratios of clusters ``b`` to ``a`` by molecules, integrations, and molecules an integration, and a call."""
    s = mols.where("doublet_prediction = 'singlet' and cluster is not null")

    def of(x: int, what: str) -> Column:
        hit = F.col("cluster") == x
        return (F.sum(hit.cast("long")) if what == "m" else F.countDistinct(F.when(hit, F.col("raw_ibar")))).alias(f"{what}_{x}")

    n = s.groupBy("cbc").agg(F.count("*").alias("mols_per_cell"), *(of(x, w) for x in (a, b) for w in ("m", "i")))
    n = n.where(f"m_{a} > 0 and m_{b} > 0")
    raw, ints = F.col(f"m_{b}") / F.col(f"m_{a}"), F.col(f"i_{b}") / F.col(f"i_{a}")
    out = n.withColumns({"score_raw": F.log10(raw), "score_ints": F.log10(ints), "score_norm": F.log10(raw / ints)})
    return out.withColumn("clone", F.when(F.col("score_norm") < 0, "left").when(F.col("score_norm") < 0.25, "mid").otherwise("right"))


def annotate_cells(cells: DataFrame, annotation: DataFrame, on: str = "cbc") -> DataFrame:
    """Left join of annotation columns in place of those of the same name."""
    return cells.drop(*(c for c in annotation.columns if c != on and c in cells.columns)).join(annotation, on, "left")


def clone_pairs(mols: DataFrame, min_marginal: int = 0, *, whitelist: DataFrame | None = None, top_cells: int | None = None, reads_per_umi: int | None = None,
                order: str = "umi") -> DataFrame:
    """Unordered pairs of barcodes that share cells: ``a, b, cells, distance`` (1 / (1 + cells)); barcodes need ``min_marginal`` cells.

    Cells are those of ``whitelist`` (cbc), else the ``top_cells`` with most UMIs, ties by name, else all.  With ``reads_per_umi`` ``mols`` has a row a read, and
    the first so many by ``order``, then barcode, of each UMI of a cell count.
    """
    if whitelist is not None:
        mols = mols.join(whitelist.select("cbc").distinct(), "cbc", "left_semi")
    elif top_cells is not None:
        size = mols.where("cbc IS NOT NULL").groupBy("cbc").agg(F.countDistinct("umi").alias("n"))
        mols = mols.join(size.orderBy(F.desc("n"), "cbc").limit(top_cells).select("cbc"), "cbc", "left_semi")
    if reads_per_umi is not None:  # Spark keeps the first rows of each group in the task before the shuffle
        (k,) = free_names(mols, "k")
        mols = mols.withColumn(k, F.row_number().over(Window.partitionBy("cbc", "umi").orderBy(*dict.fromkeys([order, "raw_ibar"])))).where(F.col(k) <= reads_per_umi)
    each = mols.select("cbc", "raw_ibar").distinct()
    if min_marginal:
        enough = each.groupBy("raw_ibar").agg(F.count("*").alias("n")).where(F.col("n") >= min_marginal)
        each = each.join(enough.select("raw_ibar"), "raw_ibar", "left_semi")
    n = pairs_in_groups(each, ["cbc"], "raw_ibar", {"raw_ibar": "a"}, {"raw_ibar": "b"}).groupBy("a", "b").agg(F.count("*").alias("cells"))
    return n.withColumn("distance", 1 / (1 + F.col("cells")))


def marginal_cut(mols: DataFrame) -> DataFrame:
    """The number of cells a barcode needs: where the cumulative histogram of cells a barcode takes its smallest step (the first)."""
    n = mols.select("cbc", "raw_ibar").distinct().groupBy("raw_ibar").agg(F.count("*").alias("cells"))
    hist = n.groupBy("cells").agg(F.count("*").alias("barcodes"))
    return hist.agg(F.min(F.struct("barcodes", "cells")).alias("b")).select(F.col("b.cells").alias("cut"))


def ibar_correlation_groups(mols: DataFrame, min_cells: int = 10, min_corr: float = 0.2) -> DataFrame:
    """Barcodes of correlated presence across cells: ``raw_ibar, grp`` by size from 1; -1 where a barcode has no partner.

    Sums over cells come from one self join on the cell; barcodes with a correlation of at least ``min_corr`` are linked; linked groups are
    hooked to the smallest name beside them until nothing changes.
    """
    x = mols.where("wt").groupBy("cbc", "raw_ibar").agg(F.count("*").cast("double").alias("x"))
    stats = x.groupBy("raw_ibar").agg(F.count("*").alias("k"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")).where(F.col("k") >= min_cells)
    n = x.select("cbc").distinct().agg(F.count("*").alias("n"))
    met = pairs_in_groups(x, ["cbc"], "raw_ibar", {"raw_ibar": "a", "x": "xa"}, {"raw_ibar": "b", "x": "xb"})
    sxy = met.groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("sxy"))
    sa, sb = (stats.select(F.col("raw_ibar").alias(v), F.col("s").alias(f"s{v}"), F.col("ss").alias(f"ss{v}")) for v in ("a", "b"))
    r = F.expr("(n * sxy - sa * sb) / sqrt((n * ssa - sa * sa) * (n * ssb - sb * sb))")
    edges = sxy.join(sa, "a").join(sb, "b").crossJoin(F.broadcast(n)).where(r >= min_corr).select("a", "b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "corr-edges")
    label = materialise(both.select("a").distinct().select("a", F.col("a").alias("root")), "corr-label")
    while True:  # the smallest root among the neighbours, then the root's own root: rounds follow the logarithm of the longest chain
        best = both.join(label.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooks = label.join(best, "a").groupBy("root").agg(F.min("near").alias("to")).where("to < root").select(F.col("root").alias("old"), F.col("to").alias("new"))
        hooks = materialise(hooks, "corr-hooks")
        if hooks.isEmpty():
            break
        roots = label.select("root").distinct().join(hooks, F.col("root") == F.col("old"), "left").select(F.col("root").alias("old"), F.coalesce("new", "root").alias("new"))
        label = materialise(label.join(merge_roots(roots).withColumnRenamed("old", "root"), "root").select("a", F.col("new").alias("root")), "corr-label")
    sizes = global_rank(label.groupBy("root").agg(F.count("*").alias("size")), "grp", -F.col("size"), F.col("root"))
    named = label.join(sizes, "root").select(F.col("a").alias("raw_ibar"), "grp")
    return stats.select("raw_ibar").join(named, "raw_ibar", "left").withColumn("grp", F.coalesce("grp", F.lit(-1)))


def clone_filter(mols: DataFrame, min_clone_share: float = 0.0) -> DataFrame:
    """Per cell the clusters it holds, the top one, its molecules and those of the second; clusters need a share of all cells."""
    n = mols.groupBy("cbc", "cluster").agg(F.count("*").alias("n"))
    total = n.select("cbc").distinct().agg(F.count("*").alias("cells"))
    big = n.groupBy("cluster").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total)).where(F.col("k") / F.col("cells") >= min_clone_share).select("cluster")
    kept = n.join(big, "cluster", "left_semi")
    ranked = F.sort_array(F.collect_list(F.struct("n", (-F.col("cluster")).alias("c"))), False)  # clusters of one cell
    per = kept.groupBy("cbc").agg(ranked.alias("r"), F.array_join(F.array_sort(F.collect_set(F.col("cluster").cast("string"))), ",").alias("clusters"), F.count("*").alias("n_clusters"))
    return per.select("cbc", "clusters", "n_clusters", (-F.col("r")[0]["c"]).alias("top_cluster"), F.col("r")[0]["n"].alias("rank1"), F.coalesce(F.try_element_at("r", F.lit(2))["n"], F.lit(0)).alias("rank2"))


def clone_table(mols: DataFrame, anchor5: str, anchor3: str, min_clone_size: float = 0.01, cell: str = "cbc", barcode: str = "raw_ibar", allele: str = "allele") -> DataFrame:
    """Molecules of clones that a share of all cells holds, with on-target flag, cell size, clone size and UMIs of their allele.

    ``ot``: both anchors stand in ``seq``; ``csize``: UMIs of the cell; ``clone_size``: share of cells with the barcode; ``allele_umis``: UMIs of
    the allele of the cell's barcode.  Distinct counts are taken by partial aggregates and joined back, so no group is held in one task.
    """
    total = mols.agg(F.countDistinct(cell).alias("__cells"))
    clones = mols.groupBy(barcode).agg(F.countDistinct(cell).alias("__k")).crossJoin(F.broadcast(total)).select(barcode, (F.col("__k") / F.col("__cells")).alias("clone_size"))
    sizes = mols.groupBy(cell).agg(F.countDistinct("umi").alias("csize"))
    kept = mols.withColumn("ot", F.col("seq").contains(anchor5) & F.col("seq").contains(anchor3)).join(clones.where(F.col("clone_size") >= min_clone_size), barcode)
    alleles = kept.groupBy(allele, cell, barcode).agg(F.countDistinct("umi").alias("allele_umis"))
    return kept.join(sizes, cell).join(alleles, [allele, cell, barcode])


def genotype_table(mols: DataFrame, key: str, value: str, top_n: int) -> DataFrame:
    """Top values of each key side by side, and the number of cases guessed from the top share: round(1 / share)."""
    n = mols.groupBy(key, value).agg(F.count("*").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    ranked = n.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_n)
    wide = ranked.groupBy(key).pivot("k", list(range(1, top_n + 1))).agg(F.first(value)).withColumnsRenamed({str(i): f"top{i}" for i in range(1, top_n + 1)})
    return wide.join(total, key).withColumn("cases", F.round(F.col("total") / F.col("top")).cast("int")).drop("total", "top")


def contacts_to_cis(contacts: DataFrame, lineage: str = "Lin") -> DataFrame:
    """Contacts (chr1, start1, chr2, start2, mol) of the lineage chromosome with another, as contacts of the other with itself, one base long."""
    chrom, at = F.concat(F.lit("chr"), F.col("chr2").cast("string")), F.col("start2").cast("long")
    trans = contacts.where((F.col("chr1") == lineage) & (F.col("chr1") != F.col("chr2")))
    return trans.select(chrom.alias("chrom1"), at.alias("start1"), (at + 1).alias("end1"), chrom.alias("chrom2"), F.col("start2").alias("start2"), (at + 1).alias("end2"), "mol")


def integration_coords(chains: DataFrame, min_points: int = 30, all_top: bool = False) -> DataFrame:
    """Chain lines ``rid ibar chrom:start,chrom:start`` to barcodes' places: top chromosome, its share, and the median distinct start.

    Barcodes need more than ``min_points`` distinct points on their top chromosome.  With ``all_top`` a barcode may have several places: its
    round(1 / top share) chromosomes with the most hits, repeated ones counted; ties by name.
    """
    parts = F.split("value", "\\s+")
    hit = chains.select(parts[1].alias("ibar"), F.explode(F.split(parts[2], ",")).alias("at")).select("ibar", F.split_part("at", F.lit(":"), F.lit(1)).alias("chrom"), F.split_part("at", F.lit(":"), F.lit(2)).try_cast("long").alias("start"))
    if all_top:
        hits = hit.where("start is not null").groupBy("ibar", "chrom").agg(F.count("*").alias("hits"))
        totals = hits.groupBy("ibar").agg(F.sum("hits").alias("total"), F.max("hits").alias("top"))
        rank = F.row_number().over(Window.partitionBy("ibar").orderBy(F.desc("hits"), "chrom"))  # a row a chromosome
        some = hits.join(totals, "ibar").withColumn("k", rank).where(F.col("k") <= F.round(F.col("total") / F.col("top")))
        medians = hit.where("start is not null").distinct().groupBy("ibar", "chrom").agg(F.count("*").alias("points"), F.percentile("start", F.lit(0.5)).alias("median_start"))
        return some.join(medians.where(F.col("points") > min_points), ["ibar", "chrom"]).select("ibar", "chrom", "points", "median_start", (F.col("hits") / F.col("total")).alias("share"))
    points = hit.where("start is not null").distinct().groupBy("ibar", "chrom").agg(F.count("*").alias("n"), F.percentile("start", F.lit(0.5)).alias("median_start"))
    top = points.groupBy("ibar").agg(F.max_by(F.struct("chrom", "n", "median_start"), F.struct("n", "chrom")).alias("t"), F.sum("n").alias("total"))
    return top.where(F.col("t.n") > min_points).select("ibar", "t.chrom", F.col("t.n").alias("points"), "t.median_start", (F.col("t.n") / F.col("total")).alias("share"))
