"""Integration barcodes, CIGAR and cs alleles, lineage vectors and character matrices."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.approximate import approx_place
from ..functions.sequence import extract_or_null
from .dictionaries import correct_by_dictionary
from .intervals import interval_join
from .pairs import pairs_in_groups
from .ranks import global_rank


def parse_contigs(contigs: DataFrame, anchor1: str, anchor2: str, sbc_names: dict[str, str] | None = None) -> DataFrame:
    """``intBC`` between the anchors (null without both), ``sbc`` by its name, and the contig from anchor 2 on."""
    out = contigs.withColumn("intBC", extract_or_null(F.col("contig"), f"{anchor1}(.+?){anchor2}", 1))
    if sbc_names:
        names = F.create_map(*(F.lit(x) for kv in sbc_names.items() for x in kv))
        out = out.withColumn("sbc", F.coalesce(names[F.col("sbc")], "sbc"))
    return out.withColumn("contig", F.regexp_replace("contig", f"^.+?{anchor2}", anchor2))


def intbc_whitelist(df: DataFrame, min_umis: int, min_proportion: float, min_ratio: float) -> DataFrame:
    """(sbc, intBC) with enough UMIs: at least ``min_umis``, a share of the sbc's UMIs, and a ratio to its largest."""
    n = df.groupBy("sbc", "intBC").agg(F.countDistinct("umi").alias("umis"), F.sum("reads").alias("reads"))
    s = n.groupBy("sbc").agg(F.sum("umis").alias("total"), F.max("umis").alias("top"))
    ratio = F.col("umis") / F.col("top")
    keep = (F.col("umis") >= F.greatest(F.lit(float(min_umis)), F.col("total") * min_proportion)) & (ratio >= min_ratio)
    return n.join(s, "sbc").where(keep).select("sbc", "intBC", "umis", "reads", ratio.alias("ratio_to_max"))


def whitelist_filter(df: DataFrame, whitelist: DataFrame, on: tuple[str, ...] = ("sbc", "intBC")) -> DataFrame:
    return df.join(whitelist.select(*on).distinct(), list(on), "left_semi")


def allele_input_table(contigs: DataFrame, labels: DataFrame, cell: str = "umi") -> DataFrame:
    """Contigs in the shape of allele calling: names from the UMI or cell, sequence with its barcode, inner-joined to labels."""
    return contigs.join(labels, "intBC").select(F.col("umi").alias("readName"), F.col(cell).alias("cellBC"), F.col("umi").alias("UMI"), F.col("reads").alias("readCount"),
                                                F.concat("intBC", "contig").alias("seq"), "intBC", "sbc", "mod")


def _tokens(cigar: str) -> Column:
    """CIGAR tokens as (operation, length, reference offset, query offset)."""
    each = F.transform(F.regexp_extract_all(F.col(cigar), F.lit("(\\d+[MIDNSHP=X])"), F.lit(1)), lambda t: F.struct(F.right(t, F.lit(1)).alias("op"), F.rtrim(t, F.lit("MIDNSHP=X")).cast("int").alias("n")))
    start = F.struct(F.array().cast("array<struct<operation:string,oper_len:int,coord:int,query:int>>").alias("out"), F.lit(0).alias("r"), F.lit(0).alias("q"))
    return F.aggregate(each, start, lambda acc, t: F.struct(
        F.concat(acc["out"], F.array(F.struct(t["op"].alias("operation"), t["n"].alias("oper_len"), acc["r"].alias("coord"), acc["q"].alias("query")))).alias("out"),
        (acc["r"] + F.when(t["op"].isin("M", "D", "N", "=", "X"), t["n"]).otherwise(0)).alias("r"),
        (acc["q"] + F.when(t["op"].isin("M", "I", "S", "=", "X"), t["n"]).otherwise(0)).alias("q")), lambda acc: acc["out"])


def cigar_ops(df: DataFrame, cigar: str = "cigar_str") -> DataFrame:
    """A row an operation: ``operation, coord`` (reference offset from 0) and ``oper_len``; no window, the offsets run inside the row."""
    return df.withColumn("__t", F.explode(_tokens(cigar))).select(*df.columns, "__t.operation", "__t.coord", "__t.oper_len")


def enrich_insertions(df: DataFrame, allele_cols: list[str], seq: str, cigar: str = "cigar_str") -> DataFrame:
    """``[pos:NI]`` as ``[pos:NI:BASES]`` in each allele column, the bases from the sequence by the CIGAR."""
    ins = F.filter(_tokens(cigar), lambda t: t["operation"] == "I")
    df = df.withColumn("__ins", F.transform(ins, lambda t: F.struct(F.concat(F.lit("["), t["coord"].cast("string"), F.lit(":"), t["oper_len"].cast("string"), F.lit("I]")).alias("k"),
                                                                    F.substring(F.col(seq), t["query"] + 1, t["oper_len"]).alias("b"))))
    for c in allele_cols:
        df = df.withColumn(c, F.aggregate("__ins", F.col(c), lambda acc, x: F.replace(acc, x["k"], F.concat(F.substring(x["k"], F.lit(1), F.length(x["k"]) - 1), F.lit(":"), x["b"], F.lit("]")))))
    return df.drop("__ins")


def spanning_deletions(df: DataFrame, rcols: list[str], mode: str = "unedited") -> DataFrame:
    """An allele that stands in two or more cut sites of a row becomes "None" (unedited), null (missing), or stays (use)."""
    if mode == "use":
        return df
    to = F.lit("None") if mode == "unedited" else F.lit(None).cast("string")

    def called(c: str) -> Column:
        others = F.filter(F.array(*rcols), lambda x: x == F.col(c))
        return F.when((F.col(c) != "None") & (F.col(c) != "") & (F.size(others) > 1), to).otherwise(F.col(c))

    return df.withColumns({c: called(c) for c in rcols})


def alignment_profile(df: DataFrame, weight: str = "n", lim: int = 50) -> DataFrame:
    """Per reference position the weighted number of each code: -1 gap, 0 match, above 0 the length of an insertion before it."""
    pairs = F.arrays_zip(F.split("aligned_ref", "").alias("a"), F.split("aligned_seq", "").alias("b"))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("ins"))
    codes = F.aggregate(F.filter(pairs, lambda p: F.coalesce(F.length(p["a"]), F.lit(0)) > 0), start, lambda acc, p: F.when(p["a"] == "-", F.struct(acc["out"].alias("out"), (acc["ins"] + 1).alias("ins"))).otherwise(
        F.struct(F.concat(acc["out"], F.array(F.when(p["b"] == "-", F.lit(-1)).otherwise(acc["ins"]))).alias("out"), F.lit(0).alias("ins"))), lambda acc: acc["out"])
    each = df.select(weight, F.posexplode(codes).alias("pos", "code")).where(F.col("pos") < lim)
    return each.groupBy("pos", "code").agg(F.sum(weight).alias("n"))


def profile_fractions(profile: DataFrame) -> DataFrame:
    total = profile.groupBy("pos").agg(F.sum("n").alias("total"))
    return profile.join(total, "pos").select("pos", "code", "n", (F.col("n") / F.col("total")).alias("fraction"))


def profile_erosion(ops: DataFrame, keys: list[str], max_coord: int) -> DataFrame:
    """Operations counted at each coordinate for all combinations of key values, zero where there are none; also per 10,000."""
    spine = ops.sparkSession.range(max_coord).select(F.col("id").cast("int").alias("coord"))
    for k in keys:  # key columns hold a few distinct values each
        spine = spine.crossJoin(ops.select(k).distinct())
    n = ops.where(F.col("coord") < max_coord).groupBy(*keys, "coord").agg(F.sum("oper_len").alias("s"), F.count("*").alias("n"))
    total = ops.agg(F.count("*").alias("total"))
    full = spine.join(n, [*keys, "coord"], "left").crossJoin(F.broadcast(total))
    return full.select(*keys, "coord", F.coalesce("s", F.lit(0)).alias("total_len"), (F.coalesce("n", F.lit(0)) * 1e4 / F.col("total")).alias("per_10k"))


def lineage_vector(df: DataFrame, intervals: list[tuple[str, int, int]], anchor: str, anchor_end: str, max_mismatch: int = 50, anchor_errors: int = 3,
                   read_end: str = "merged", read_length: int = 0) -> DataFrame:
    """``barcode``: per interval ``mismatches.insertions.deletions`` of an aligned pair, joined by ``|``.

    Reference coordinates count bases of the reference, so an insertion shifts nothing.  The pair is cut to the first anchor, within ``anchor_errors`` edits, of
    the read.  Without either anchor the row is ``trash-unmatched``; with eight As or Gs in a row inserted or deleted inside the intervals it is
    ``trash-gen``.  An interval that is deleted whole is ``..exx``; one with more than ``max_mismatch`` mismatches is ``.NA.``.  Without the end
    anchor every ``..exx``, and the last interval if it isn't unchanged, is ``.NA.``: nothing shows where the deletion ends.  Of a pair's
    ``read1`` the intervals from the one that holds reference base ``read_length`` on are ``.NA.``, of its ``read2`` those up to the one that
    holds the base ``read_length`` before the end.
    """
    at = approx_place(F.col("aligned_seq"), anchor, anchor_errors)
    out = df.withColumns({"__at": at, "__end": approx_place(F.col("aligned_seq"), anchor_end, anchor_errors) > 0}).withColumn("__cut", F.greatest("__at", F.lit(1)))
    args = (tuple((a, b) for _, a, b in intervals), max_mismatch, read_end, read_length)

    @F.pandas_udf("string")
    def told(ref: pd.Series, seq: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([_interval_codes(r, s, e is not None and not pd.isna(e) and not e, *args) for r, s, e in zip(ref, seq, end, strict=True)], index=ref.index, dtype=object)

    codes = told(F.expr("upper(substr(aligned_ref, __cut))"), F.expr("upper(substr(aligned_seq, __cut))"), F.col("__end"))
    barcode = F.when((F.col("__at") == 0) & ~F.col("__end"), "trash-unmatched").otherwise(codes)
    return out.withColumn("barcode", barcode).drop("__at", "__end", "__cut")


_POLY = re.compile("A{8}|G{8}|a{8}|g{8}")


@lru_cache(maxsize=1 << 15)
def _interval_codes(ref: str | None, seq: str | None, no_end: bool, intervals: tuple[tuple[int, int], ...], max_mismatch: int, read_end: str, read_length: int) -> str:
    """The codes of one pair that is cut to its anchor, or ``trash-gen``; those of a worker's last pairs are remembered."""
    first, last = min(a for a, _ in intervals), max(b for _, b in intervals)
    counts = [{"m": 0, "i": 0, "d": 0} for _ in intervals]
    at, runs = -1, []
    for a, b in zip_longest(ref, seq[: len(ref)]) if ref is not None and seq is not None else ():
        if a == "-":
            place, kind, letter = max(at, 0), "i", b or ""
        else:
            at += 1
            place = at
            kind, letter = ("=", ".") if a == b else ("d", a.lower()) if b == "-" else ("m", ".")
        if first <= place <= last:
            runs.append(letter)
            if kind != "=":
                for n, (x, y) in zip(counts, intervals, strict=True):
                    if x <= place <= y:
                        n[kind] += 1
    if _POLY.search("".join(runs)):
        return "trash-gen"
    n_ref = at + 1 if ref is not None and seq is not None else None
    out = []
    for i, (n, (x, y)) in enumerate(zip(counts, intervals, strict=True)):
        nxt = intervals[i + 1][0] if i + 1 < len(intervals) else 1 << 30
        unread = nxt > read_length if read_end == "read1" else read_end == "read2" and n_ref is not None and x <= n_ref - read_length
        whole = ".NA." if unread or n["m"] > max_mismatch else "..exx" if n["d"] == y - x + 1 else ".".join(str(n[k] or "") for k in "mid")
        lost = whole == "..exx" if i + 1 < len(intervals) else whole != ".."
        out.append(".NA." if no_end and lost else whole)
    return "|".join(out)


def cs_alleles(df: DataFrame, loci: DataFrame, window: int = 60) -> DataFrame:
    """Alleles of ``cs`` tags of reads that start within ``window`` of a locus.

    ``hallele``: indels with absolute coordinates; ``sallele``: mismatches; lengths of insertions and deletions.  ``loci`` (locus, rname, pos)
    may be any number of guides: they are met by bins of the chromosome.
    """
    token = F.regexp_extract_all(F.col("cs"), F.lit("(:\\d+|\\*[a-z]{2}|\\+[a-z]+|-[a-z]+|~[a-z]{2}\\d+[a-z]{2})"), F.lit(1))
    start = F.struct(F.array().cast("array<struct<k:string,t:string,p:long,n:int>>").alias("out"), F.col("pos").cast("long").alias("r"))

    def step(acc: Column, t: Column) -> Column:
        k, rest = F.substring(t, 1, 1), F.substring(t, F.lit(2), F.length(t))
        n = F.when(k == ":", rest.try_cast("int")).when(k == "*", F.lit(1)).when(k == "~", F.regexp_extract(t, "(\\d+)", 1).try_cast("int")).otherwise(F.length(rest))
        return F.struct(F.concat(acc["out"], F.array(F.struct(k.alias("k"), rest.alias("t"), acc["r"].alias("p"), n.alias("n")))).alias("out"), (acc["r"] + F.when(k == "+", 0).otherwise(n)).alias("r"))

    at = F.col("locus_pos")
    near = interval_join(df, loci.withColumnRenamed("pos", "locus_pos"), ["rname"], (F.col("pos"), F.col("pos")), (at - window, at + window), max(1000, 2 * window + 1))
    out = near.withColumn("__e", F.aggregate(token, start, step, lambda acc: acc["out"]))

    def kind(*kinds: str) -> Column:
        return F.filter("__e", lambda e: e["k"].isin(*kinds))

    def told(e: Column) -> Column:
        return F.concat(e["p"].cast("string"), e["k"], e["t"])

    return out.select(*df.columns, "locus", F.array_join(F.transform(kind("+", "-", "~"), told), ":").alias("hallele"), F.array_join(F.transform(kind("*"), told), ":").alias("sallele"),
                      F.transform(kind("+"), lambda e: e["n"]).alias("ins_lengths"), F.transform(kind("-"), lambda e: e["n"]).alias("del_lengths"))


def cs_allele_table(df: DataFrame, loci: DataFrame, window: int = 60, cells: DataFrame | None = None, umis: DataFrame | None = None) -> DataFrame:
    """The 14 columns of called alleles, and the locus: ``chr, start, cr, cb, ur, ub, molid, cs, cigar, iv, dv, hallele, sallele, seq``.

    ``df`` has ``name, rname, pos, cs, cigar_str, seq`` and the raw barcodes ``cr`` and ``ur``; a null one is read from the name's ``:Z:`` fields.  ``cells``
    and ``umis`` are dictionaries (raw, corrected) of any size.  ``cb`` and ``ub`` are ``NA`` without a dictionary or an entry; ``molid`` joins the raw
    barcodes; ``iv`` and ``dv`` are the CIGAR's lengths of insertions and deletions, ``0`` for none; ``hallele`` is ``wildtype`` and ``sallele``
    ``NA`` where empty.  Rows without ``cs`` or ``seq`` give none.
    """
    fields = F.split("name", ":Z:")
    raw = df.where("cs IS NOT NULL AND seq IS NOT NULL").withColumns({
        "cr": F.coalesce("cr", F.split(F.get(fields, F.lit(1)), "_")[0]), "ur": F.coalesce("ur", F.get(fields, F.lit(2)))})
    out = cs_alleles(raw.select("rname", "pos", "cr", "ur", "cs", "cigar_str", "seq"), loci, window)
    for dictionary, of, to in ((cells, "cr", "cb"), (umis, "ur", "ub")):
        out = out.withColumn(to, F.lit("NA")) if dictionary is None else correct_by_dictionary(out, dictionary, of, to, "NA")

    def lengths(op: str) -> Column:
        n = F.array_join(F.regexp_extract_all("cigar_str", F.lit(f"(\\d+){op}"), F.lit(1)), ",")
        return F.when(n == "", "0").otherwise(n)

    return out.select(F.col("rname").alias("chr"), F.col("pos").alias("start"), "cr", "cb", "ur", "ub", F.concat("cr", "ur").alias("molid"), "cs", F.col("cigar_str").alias("cigar"),
                      lengths("I").alias("iv"), lengths("D").alias("dv"), F.when(F.col("hallele") == "", "wildtype").otherwise(F.col("hallele")).alias("hallele"),
                      F.when(F.col("sallele") == "", "NA").otherwise(F.col("sallele")).alias("sallele"), "seq", "locus")


def cigar_allele_string(df: DataFrame, cigar: str = "cigar_str") -> DataFrame:
    """``allele``: ``{coordinate}{operation}`` of the CIGAR without first and last token, joined by ``:``; ``NA`` if empty."""
    toks = _tokens(cigar)
    inner = F.when(F.size(toks) > 2, F.slice(toks, 2, F.size(toks) - 2)).otherwise(F.filter(toks, lambda t: F.lit(False)))
    text = F.array_join(F.transform(inner, lambda t: F.concat(t["coord"].cast("string"), t["operation"])), ":")
    return df.withColumn("allele", F.when(text == "", "NA").otherwise(text))


def allele_long(mols: DataFrame, cell: str, site: str, allele: str) -> DataFrame:
    """One allele a (cell, site): the most frequent, ties by text."""
    n = mols.groupBy(cell, site, allele).agg(F.count("*").alias("n"))
    return n.groupBy(cell, site).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(allele).alias("a"))).alias("b")).select(F.col(cell).alias("cell"), F.col(site).alias("site"), F.col("b.a").alias("allele"))


def allele_matrix(long: DataFrame, sites: list[str]) -> DataFrame:
    """Wide form of a long (cell, site, allele) table over the given sites; ``NA`` where a cell lacks one."""
    return long.groupBy("cell").pivot("site", sites).agg(F.first("allele")).fillna("NA")


def allele_matrix_long(long: DataFrame) -> DataFrame:
    """The whole matrix, a row for each (cell, site) of the table: ``cell, site, allele``; ``NA`` where a cell lacks one.  Cells times sites rows are the result asked for."""
    spine = long.select("cell").distinct().crossJoin(long.select("site").distinct())
    return spine.join(long, ["cell", "site"], "left").fillna("NA", ["allele"])


def allele_codes(long: DataFrame) -> DataFrame:
    """Integer code of each allele in the order of its text, over all sites: ``cell, site, code``.  The table of distinct alleles is ranked, not the matrix."""
    coded = global_rank(long.select("allele").distinct(), "code", F.col("allele"))
    return long.join(coded, "allele").select("cell", "site", "code")


def allele_profiles(codes: DataFrame) -> DataFrame:
    """Cells with the same codes: ``profile, cells, members``; a profile lists site:code in site order."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("site", "code"))), lambda s: F.concat_ws(":", s["site"], s["code"].cast("string")))
    per = codes.groupBy("cell").agg(F.array_join(each, ",").alias("profile"))
    return per.groupBy("profile").agg(F.count("*").alias("cells"), F.min("cell").alias("representative"))


def allele_similarity(codes: DataFrame, bias: float = 1.0, dont_include: int = 3) -> DataFrame:
    """Similarity of cells: the sum of bias squared over sites where both have the same code above ``dont_include``.

    Only one cell of each profile is compared; members share its row.
    """
    per = codes.groupBy("cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "code"))), lambda s: F.concat_ws(":", s["site"], s["code"].cast("string"))), ",").alias("profile"))
    reps = per.groupBy("profile").agg(F.min("cell").alias("cell"))
    some = codes.join(reps.select("cell"), "cell", "left_semi").where(F.col("code") > dont_include)
    pairs = pairs_in_groups(some, ["site", "code"], "cell", {"cell": "cell"}, {"cell": "other"})
    return pairs.groupBy("cell", "other").agg(F.sum(F.lit(bias * bias)).alias("similarity"))


def indel_stats(long: DataFrame) -> DataFrame:
    """Frequency and rank of each allele at its site (without NA): ``site, allele, n, fraction, rank``."""
    n = long.where("allele != 'NA'").groupBy("site", "allele").agg(F.count("*").alias("n"))
    total = n.groupBy("site").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("site").orderBy(F.desc("n"), "allele")
    return n.join(total, "site").select("site", "allele", "n", (F.col("n") / F.col("total")).alias("fraction"), F.row_number().over(w).alias("rank"))


def uncut_fraction(long: DataFrame, wt: str = "wt") -> DataFrame:
    """Per site detected cells and the share that is uncut."""
    return long.where("allele != 'NA'").groupBy("site").agg(F.count("*").alias("cells"), F.avg((F.col("allele") == wt).cast("int")).alias("uncut"))


def lane_merge_filter(lanes: list[DataFrame], whitelist: DataFrame | None = None, top_labels: int | None = None, label: str = "label") -> DataFrame:
    """Lanes under each other, cells with their lane as suffix; optionally listed cells only, and the most frequent labels only."""
    out = None
    for i, lane in enumerate(lanes, 1):
        one = lane.withColumn("cell", F.concat("cell", F.lit(f"-{i}")))
        out = one if out is None else out.unionByName(one)
    if whitelist is not None:
        out = out.join(whitelist.select("cell").distinct(), "cell", "left_semi")
    if top_labels is not None:
        top = out.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(top_labels)
        out = out.join(top.select(label), label, "left_semi")
    return out


def character_matrix(long: DataFrame, rep_threshold: float = 1.0) -> DataFrame:
    """Integer states of characters: -1 missing, 0 uncut, then by rank of the allele's text within its site.

    Characters whose most frequent state reaches more than ``rep_threshold`` of its cells are dropped.
    """
    distinct = long.where("allele not in ('NA', 'wt')").select("site", "allele").distinct()
    ranked = distinct.withColumn("k", F.dense_rank().over(Window.partitionBy("site").orderBy("allele")))
    coded = long.join(ranked, ["site", "allele"], "left").select("cell", "site", F.when(F.col("allele") == "NA", -1).when(F.col("allele") == "wt", 0).otherwise(F.col("k")).cast("int").alias("state"))
    n = coded.where("state >= 0").groupBy("site", "state").agg(F.count("*").alias("n")).groupBy("site").agg((F.max("n") / F.sum("n")).alias("top"))
    return coded.join(n.where(F.col("top") <= rep_threshold).select("site"), "site", "left_semi")


def character_stats(matrix: DataFrame) -> DataFrame:
    """Per character: share missing, share uncut among the rest, number of states."""
    s = F.col("state")
    return matrix.groupBy("site").agg(F.avg((s < 0).cast("int")).alias("missing"), F.avg(F.when(s >= 0, (s == 0).cast("int"))).alias("uncut"),
                                      F.countDistinct(F.when(s > 0, s)).alias("states"))


def indel_priors(alleles: DataFrame, groups: list[str]) -> DataFrame:
    """Share of the (intBC, group) pairs that hold each indel."""
    total = alleles.select("intBC", *groups).distinct().agg(F.count("*").alias("total"))
    n = alleles.where("allele not in ('NA', 'wt')").select("allele", "intBC", *groups).distinct().groupBy("allele").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("allele", "n", (F.col("n") / F.col("total")).alias("freq"))


def top_allele_contrast(mols: DataFrame) -> DataFrame:
    """Per (cell, ibar) the UMIs of the top uncut and the top cut allele, and log10(1 + x) of both."""
    n = mols.groupBy("cbc", "raw_ibar", "wt", "seq").agg(F.countDistinct("umi").alias("n"))
    top = n.groupBy("cbc", "raw_ibar").agg(F.coalesce(F.max(F.when(F.col("wt"), F.col("n"))), F.lit(0)).alias("umis_wt"), F.coalesce(F.max(F.when(~F.col("wt"), F.col("n"))), F.lit(0)).alias("umis_cut"))
    return top.withColumns({"log_wt": F.log10(1 + F.col("umis_wt")), "log_cut": F.log10(1 + F.col("umis_cut"))})
