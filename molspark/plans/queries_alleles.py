"""Queries of the allele, alignment and matrix operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align as al
from ..operators import alleles as a
from ..operators import composite
from .constants import INT_ANCHOR1, INT_ANCHOR2
from .registry import Inputs, query

_CONTIGS = "(SELECT substr(r1_seq, 1, 12) AS umi, substr(r1_seq, 13, 6) AS sbc, r2_seq AS contig FROM fx_reads) AS c0"
_PARSED = f"""(SELECT umi, CASE sbc WHEN 'AAAGAG' THEN 'sampleA' ELSE sbc END AS sbc, CASE WHEN regexp_matches(contig, '{INT_ANCHOR1}(.+?){INT_ANCHOR2}') THEN regexp_extract(contig, '{INT_ANCHOR1}(.+?){INT_ANCHOR2}', 1) END AS "intBC",
  regexp_replace(contig, '^.+?{INT_ANCHOR2}', '{INT_ANCHOR2}') AS contig FROM {_CONTIGS}) AS pc"""


def parsed(t: Inputs) -> DataFrame:
    c = t.fx_reads.select(F.substring("r1_seq", 1, 12).alias("umi"), F.substring("r1_seq", 13, 6).alias("sbc"), F.col("r2_seq").alias("contig"))
    return a.parse_contigs(c, INT_ANCHOR1, INT_ANCHOR2, {"AAAGAG": "sampleA"})


@query("parse_contigs", f'SELECT umi, sbc, "intBC", contig FROM {_PARSED}')
def parse_contigs(t: Inputs) -> DataFrame:
    return parsed(t).select("umi", "sbc", "intBC", "contig")


_WL = """(SELECT sbc, "intBC", umis, reads, umis / top AS ratio_to_max FROM (SELECT *, sum(umis) OVER (PARTITION BY sbc) AS total, max(umis) OVER (PARTITION BY sbc) AS top FROM
  (SELECT sample_id AS sbc, raw_ibar AS "intBC", count(DISTINCT umi) AS umis, CAST(sum(umi_reads) AS BIGINT) AS reads FROM fx_mols GROUP BY 1, 2) AS n) AS w WHERE umis >= greatest(5, total * 0.01) AND umis / top >= 0.8) AS wl"""


def mols(t: Inputs) -> DataFrame:
    return t.fx_mols.select(F.col("sample_id").alias("sbc"), F.col("raw_ibar").alias("intBC"), "umi", F.col("umi_reads").alias("reads"), "seq")


@query("intbc_whitelist", f'SELECT sbc, "intBC", umis, reads, round(ratio_to_max, 9) AS ratio_to_max FROM {_WL}')
def intbc_whitelist(t: Inputs) -> DataFrame:
    return a.intbc_whitelist(mols(t), 5, 0.01, 0.8).withColumn("ratio_to_max", F.round("ratio_to_max", 9))


@query("whitelist_filter", f"""SELECT umi, sbc, "intBC" FROM (SELECT umi, sample_id AS sbc, raw_ibar AS "intBC" FROM fx_mols) AS m SEMI JOIN {_WL} USING (sbc, "intBC")""")
def whitelist_filter(t: Inputs) -> DataFrame:
    return a.whitelist_filter(mols(t), a.intbc_whitelist(mols(t), 5, 0.01, 0.8)).select("umi", "sbc", "intBC")


@query("allele_input_table", """SELECT umi AS "readName", umi AS "cellBC", umi AS "UMI", umi_reads AS "readCount", concat(raw_ibar, seq) AS seq, raw_ibar AS "intBC", sample_id AS sbc, mod
  FROM fx_mols JOIN (SELECT raw_ibar, concat('mod', CAST(min(cluster) AS STRING)) AS mod FROM fx_mols WHERE wt GROUP BY 1) AS l USING (raw_ibar)""")
def allele_input_table(t: Inputs) -> DataFrame:
    labels = t.fx_mols.where("wt").groupBy(F.col("raw_ibar").alias("intBC")).agg(F.concat(F.lit("mod"), F.min("cluster").cast("string")).alias("mod"))
    return a.allele_input_table(mols(t).withColumnRenamed("seq", "contig"), labels)


@query("align_alleles")
def align_alleles(t: Inputs) -> DataFrame:
    g = t.fx_guides.select("umi", F.regexp_extract("seq", "CTAGA(.{6})AATAGCAA", 1).alias("raw_ibar"), "seq").withColumn("wt", F.length(F.regexp_extract("seq", "GGG(.*?)GGGTTAG", 1)) == 20)
    return al.align_alleles(g, ["raw_ibar"], "ATGGG", "GGGTTAG", min_group_size=5).select("umi", "raw_ibar", "ref", "seq", "cigar_str", "alignment_score")


_ALN = "(SELECT CAST(umi_reads AS INT) AS start, CAST(umi_reads + umi_dom_reads AS INT) AS \"end\" FROM fx_mols) AS aln"
_COV = f"(SELECT CAST(pos AS INT) AS pos, (SELECT count(*) FROM {_ALN} WHERE start <= pos AND \"end\" > pos) AS coverage FROM range(100) AS g(pos)) AS cov"


def _aln(t: Inputs) -> DataFrame:
    return t.fx_mols.select(F.col("umi_reads").alias("start"), (F.col("umi_reads") + F.col("umi_dom_reads")).alias("end"))


@query("coverage_by_position", f"SELECT * FROM {_COV}")
def coverage_by_position(t: Inputs) -> DataFrame:
    return al.coverage_by_position(_aln(t), 100)


@query("coverage_compare", f"""WITH r AS (SELECT pos, coverage FROM {_COV} WHERE pos BETWEEN 10 AND 60), k AS (SELECT CAST(pos + 20 AS INT) AS pos, coverage FROM {_COV} WHERE pos + 20 BETWEEN 10 AND 60)
  SELECT coalesce(r.pos, k.pos) AS pos, round(r.coverage / (SELECT sum(coverage) FROM r), 9) AS raw, round(k.coverage / (SELECT sum(coverage) FROM k), 9) AS contigs FROM r FULL JOIN k ON r.pos = k.pos""")
def coverage_compare(t: Inputs) -> DataFrame:
    raw = al.coverage_by_position(_aln(t), 100)
    out = al.coverage_compare(raw, raw.withColumn("pos", F.col("pos") + 20), 10, 60)
    return out.select("pos", F.round("raw", 9).alias("raw"), F.round("contigs", 9).alias("contigs"))


_CG = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 10 + l_linenumber AS m, 1 + l_orderkey % 3 AS n, CASE WHEN l_orderkey % 2 = 0 THEN 'D' ELSE 'I' END AS op, cigar_str FROM fx_cigar) AS cg"""


@query("cigar_ops", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, operation, CAST(coord AS INT) AS coord, CAST(oper_len AS INT) AS oper_len FROM
  (SELECT *, 'M' AS operation, 0 AS coord, m AS oper_len FROM {_CG} UNION ALL SELECT *, op, m, n FROM {_CG} UNION ALL SELECT *, 'M', m + CASE WHEN op = 'D' THEN n ELSE 0 END, 20 FROM {_CG}) AS o""")
def cigar_ops(t: Inputs) -> DataFrame:
    return a.cigar_ops(t.fx_cigar).drop("cigar_str")


@query("enrich_insertions", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN op = 'I' THEN concat('[', CAST(m AS STRING), ':', CAST(n AS STRING), 'I:', substr(repeat(md5(CAST(l_partkey AS STRING)), 2), CAST(m + 1 AS BIGINT), CAST(n AS BIGINT)), ']')
  ELSE 'None' END AS r1 FROM {_CG}""")
def enrich_insertions(t: Inputs) -> DataFrame:
    d = t.fx_cigar.withColumns({"seq": F.repeat(F.md5(F.col("l_partkey").cast("string")), F.lit(2)), "r1": F.expr(
        "case when l_orderkey % 2 = 0 then 'None' else concat('[', cast(10 + l_linenumber as string), ':', cast(1 + l_orderkey % 3 as string), 'I]') end")})
    return a.enrich_insertions(d, ["r1"], "seq").drop("cigar_str", "seq")


_R3 = "(SELECT umi, CASE umi_reads % 4 WHEN 0 THEN 'None' WHEN 1 THEN '' ELSE concat('d', CAST(umi_reads % 5 AS STRING)) END AS r1, concat('d', CAST(umi_reads % 3 AS STRING)) AS r2, concat('d', CAST(cluster AS STRING)) AS r3 FROM fx_mols) AS r3t"


@query("spanning_deletions", "SELECT umi, " + ", ".join(f"CASE WHEN {c} NOT IN ('None', '') AND CAST(r1 = {c} AS INT) + CAST(r2 = {c} AS INT) + CAST(r3 = {c} AS INT) > 1 THEN 'None' ELSE {c} END AS {c}" for c in ("r1", "r2", "r3")) + f" FROM {_R3}")
def spanning_deletions(t: Inputs) -> DataFrame:
    d = t.fx_mols.selectExpr("umi", "case umi_reads % 4 when 0 then 'None' when 1 then '' else concat('d', cast(umi_reads % 5 as string)) end as r1", "concat('d', cast(umi_reads % 3 as string)) as r2", "concat('d', cast(cluster as string)) as r3")
    return a.spanning_deletions(d, ["r1", "r2", "r3"])


_AL = "(SELECT umi_reads AS n, spacer AS aligned_ref, concat(substr(spacer, 1, 8), repeat('-', umi_reads % 5), substr(spacer, 9 + umi_reads % 5)) AS aligned_seq FROM fx_mols) AS al"


@query("alignment_profile", f"""SELECT CAST(i - 1 AS INT) AS pos, CASE WHEN substr(aligned_seq, CAST(i AS BIGINT), 1) = '-' THEN -1 ELSE 0 END AS code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, unnest(range(1, 21)) AS i FROM {_AL}) AS e GROUP BY 1, 2""")
def alignment_profile(t: Inputs) -> DataFrame:
    d = t.fx_mols.selectExpr("umi_reads as n", "spacer as aligned_ref", "concat(substr(spacer, 1, 8), repeat('-', umi_reads % 5), substr(spacer, 9 + umi_reads % 5)) as aligned_seq")
    return a.alignment_profile(d)


@query("profile_erosion", f"""WITH o AS (SELECT op AS operation, l_linenumber, CAST(m AS INT) AS coord, n AS oper_len FROM {_CG})
  SELECT operation, l_linenumber, coord, CAST(coalesce(s, 0) AS BIGINT) AS total_len, round(coalesce(n, 0) * 1e4 / (SELECT count(*) FROM o), 9) AS per_10k FROM
  (SELECT operation, l_linenumber, CAST(c AS INT) AS coord FROM (SELECT DISTINCT operation FROM o) AS a, (SELECT DISTINCT l_linenumber FROM o) AS b, range(20) AS g(c)) AS k
  LEFT JOIN (SELECT operation, l_linenumber, coord, sum(oper_len) AS s, count(*) AS n FROM o GROUP BY 1, 2, 3) AS v USING (operation, l_linenumber, coord)""")
def profile_erosion(t: Inputs) -> DataFrame:
    ops = a.cigar_ops(t.fx_cigar).where("operation in ('I', 'D')")
    return a.profile_erosion(ops, ["operation", "l_linenumber"], 20).withColumn("per_10k", F.round("per_10k", 9))


@query("profile_erosion_lines", f"""WITH o AS (SELECT op AS operation, l_linenumber, CAST(m AS INT) AS coord, n AS oper_len FROM {_CG})
  SELECT operation, l_linenumber, coord, CAST(coalesce(s, 0) AS BIGINT) AS total_len, round(coalesce(n, 0) * 1e4 / (SELECT count(*) FROM o), 9) AS per_10k FROM
  (SELECT operation, l_linenumber, CAST(c AS INT) AS coord FROM (SELECT DISTINCT operation FROM o) AS a, (SELECT DISTINCT l_linenumber FROM o) AS b, range(20) AS g(c)) AS k
  LEFT JOIN (SELECT operation, l_linenumber, coord, sum(oper_len) AS s, count(*) AS n FROM o GROUP BY 1, 2, 3) AS v USING (operation, l_linenumber, coord)""")
def profile_erosion_lines(t: Inputs) -> DataFrame:
    ops = a.cigar_ops(t.fx_cigar).where("operation in ('I', 'D')")
    return a.profile_erosion(ops, ["operation", "l_linenumber"], 20).withColumn("per_10k", F.round("per_10k", 9))


# aligned pairs with insertions, deletions up to a whole interval, runs of one letter, and missing anchors
_ADAPT, _TAIL = "ACGTTGCATTGCA", "GGTTCCAATGG"
_REF = f"concat('{_ADAPT}', substr(spacer, 1, 10), CASE WHEN umi_reads % 13 = 0 THEN '--------' WHEN umi_reads % 3 = 0 THEN '--' ELSE '' END, substr(spacer, 11), '{_TAIL}')"
_READ = (f"concat(CASE WHEN umi_reads % 11 = 0 THEN 'NNNNNNNNNNNNN' ELSE '{_ADAPT}' END, substr(seq, 1, 10), CASE WHEN umi_reads % 13 = 0 THEN 'AAAAAAAA' WHEN umi_reads % 3 = 0 THEN 'AC' ELSE '' END, "
         f"CASE WHEN umi_reads % 17 = 0 THEN '----------' ELSE concat(substr(seq, 11, 3), repeat('-', CAST(umi_reads % 5 AS INT)), substr(seq, CAST(14 + umi_reads % 5 AS INT))) END, CASE WHEN umi_reads % 7 = 0 THEN 'NNNNNNNNNNN' ELSE '{_TAIL}' END)")
_BINS = [("b1", 13, 18), ("b2", 19, 22), ("b3", 23, 32)]


def _bin_code(i: int, first: int, last: int) -> str:
    n = {k: f"count(*) FILTER (WHERE p BETWEEN {first} AND {last} AND k = '{k}')" for k in "mid"}
    text = ", ".join(f"CASE WHEN {n[k]} > 0 THEN CAST({n[k]} AS STRING) ELSE '' END" for k in "mid")
    code = f"CASE WHEN {n['m']} > 3 THEN '.NA.' WHEN {n['d']} = {last - first + 1} THEN '..exx' ELSE concat_ws('.', {text}) END"
    return f"CASE WHEN NOT max(has_end) AND {code} {chr(61) if i < 2 else '<>'} '{'..exx' if i < 2 else '..'}' THEN '.NA.' ELSE {code} END"


@query("lineage_vector", f"""WITH d AS (SELECT row_number() OVER () AS rid, umi, {_REF} AS aligned_ref, {_READ} AS aligned_seq FROM fx_mols),
  a AS (SELECT *, strpos(aligned_seq, '{_ADAPT}') AS at_, contains(aligned_seq, '{_TAIL}') AS has_end FROM d),
  e AS (SELECT rid, has_end, i, substr(aligned_ref, i, 1) AS a, substr(aligned_seq, i, 1) AS b FROM (SELECT *, CAST(unnest(range(greatest(at_, 1), length(aligned_ref) + 1)) AS BIGINT) AS i FROM a) AS x),
  r AS (SELECT *, sum(CASE WHEN a <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) - 1 AS r FROM e),
  k AS (SELECT rid, has_end, i, a, b, CASE WHEN a = '-' THEN greatest(r, 0) ELSE r END AS p, CASE WHEN a = '-' THEN 'i' WHEN a = b THEN '=' WHEN b = '-' THEN 'd' ELSE 'm' END AS k FROM r),
  c AS (SELECT rid, concat_ws('|', {", ".join(_bin_code(i, x, y) for i, (_, x, y) in enumerate(_BINS))}) AS codes,
    regexp_matches(string_agg(CASE WHEN p BETWEEN 13 AND 32 THEN CASE k WHEN 'i' THEN b WHEN 'd' THEN lower(a) ELSE '.' END ELSE '' END, '' ORDER BY i), 'A{{8}}|G{{8}}|a{{8}}|g{{8}}') AS poly FROM k GROUP BY 1)
  SELECT umi, aligned_ref, aligned_seq, CASE WHEN at_ = 0 AND NOT has_end THEN 'trash-unmatched' WHEN poly THEN 'trash-gen' ELSE codes END AS barcode FROM a JOIN c USING (rid)""")
def lineage_vector(t: Inputs) -> DataFrame:
    d = t.fx_mols.selectExpr("umi", f"{_REF} as aligned_ref", f"{_READ} as aligned_seq")
    return a.lineage_vector(d, _BINS, _ADAPT, _TAIL, max_mismatch=3, anchor_errors=0)


@query("cs_alleles", """WITH d AS (SELECT row_number() OVER () AS rid, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS name, concat('chr', CAST(l_suppkey % 3 AS STRING)) AS rname, 100 + l_linenumber AS pos,
    concat(':', CAST(10 + l_linenumber AS STRING), CASE WHEN l_orderkey % 2 = 0 THEN '-ac' ELSE '+gg' END, ':5*ag:', CAST(l_orderkey % 7 AS STRING)) AS cs FROM fx_cigar),
  n AS (SELECT d.*, locus FROM d JOIN (VALUES ('g0', 'chr0', 100), ('g1', 'chr1', 104)) AS v(locus, rname, at_) ON d.rname = v.rname AND abs(pos - at_) <= 3),
  t AS (SELECT *, unnest(regexp_extract_all(cs, '(:[0-9]+|[*][a-z]{2}|[+][a-z]+|-[a-z]+|~[a-z]{2}[0-9]+[a-z]{2})')) AS tok, generate_subscripts(regexp_extract_all(cs, '(:[0-9]+|[*][a-z]{2}|[+][a-z]+|-[a-z]+|~[a-z]{2}[0-9]+[a-z]{2})'), 1) AS i FROM n),
  l AS (SELECT *, left(tok, 1) AS k, substr(tok, 2) AS rest, CASE left(tok, 1) WHEN ':' THEN CAST(substr(tok, 2) AS INT) WHEN '*' THEN 1 WHEN '~' THEN CAST(regexp_extract(tok, '([0-9]+)', 1) AS INT) ELSE length(tok) - 1 END AS n FROM t),
  p AS (SELECT *, pos + coalesce(sum(CASE WHEN k = '+' THEN 0 ELSE n END) OVER (PARTITION BY rid, locus ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM l)
  SELECT any_value(name) AS name, any_value(rname) AS rname, any_value(pos) AS pos, any_value(cs) AS cs, locus, coalesce(string_agg(CASE WHEN k IN ('+', '-', '~') THEN concat(CAST(p AS STRING), tok) END, ':' ORDER BY i), '') AS hallele,
    coalesce(string_agg(CASE WHEN k = '*' THEN concat(CAST(p AS STRING), tok) END, ':' ORDER BY i), '') AS sallele, coalesce(string_agg(CASE WHEN k = '+' THEN CAST(n AS STRING) END, ',' ORDER BY i), '') AS ins_lengths,
    coalesce(string_agg(CASE WHEN k = '-' THEN CAST(n AS STRING) END, ',' ORDER BY i), '') AS del_lengths FROM p GROUP BY rid, locus""")
def cs_alleles(t: Inputs) -> DataFrame:
    d = t.fx_cigar.selectExpr("concat(l_orderkey, '-', l_linenumber) as name", "concat('chr', l_suppkey % 3) as rname", "100 + l_linenumber as pos", "concat(':', 10 + l_linenumber, if(l_orderkey % 2 = 0, '-ac', '+gg'), ':5*ag:', l_orderkey % 7) as cs")
    loci = t.spark.createDataFrame([("g0", "chr0", 100), ("g1", "chr1", 104)], "locus string, rname string, pos int")
    return a.cs_alleles(d, loci, 3).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("ins_lengths", "del_lengths")})


#: Reads with cs tags; some have no barcode but in their name, some no tag or no sequence.
_CS_READS = """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), ':Z:', substr(translate(md5(concat('c', CAST(l_orderkey % 200 AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16), '_x:Z:', CAST(l_partkey AS STRING)) AS name,
  concat('chr', CAST(l_suppkey % 3 AS STRING)) AS rname, 100 + l_linenumber AS pos,
  CASE WHEN l_orderkey % 11 <> 0 THEN concat(':', CAST(10 + l_linenumber AS STRING), CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 2 = 0 THEN '-ac' ELSE '+gg' END, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE ':5*ag' END, ':', CAST(l_orderkey % 7 AS STRING)) END AS cs, cigar_str,
  CASE WHEN l_linenumber % 2 = 0 THEN substr(translate(md5(concat('c', CAST(l_orderkey % 200 AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) END AS cr, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey AS STRING) END AS ur,
  CASE WHEN l_orderkey % 13 <> 0 THEN cigar_str END AS seq FROM fx_cigar"""
_CELL_DICTIONARY = "SELECT DISTINCT cbc AS raw, concat(substr(cbc, 1, 12), 'AAAA') AS corrected FROM fx_mols WHERE sample_id <> 'S1' AND raw_ibar < 'G'"
_UMI_DICTIONARY = "SELECT DISTINCT CAST(l_partkey AS STRING) AS raw, concat('u', CAST(l_partkey - l_partkey % 3 AS STRING)) AS corrected FROM fx_cigar WHERE l_partkey % 2 = 0"


@query("cs_allele_table", f"""WITH r AS ({_CS_READS}), d AS (SELECT row_number() OVER () AS rid, * REPLACE (coalesce(cr, split_part(split_part(name, ':Z:', 2), '_', 1)) AS cr, coalesce(ur, split_part(name, ':Z:', 3)) AS ur) FROM r WHERE cs IS NOT NULL AND seq IS NOT NULL),
  n AS (SELECT d.*, locus FROM d JOIN (VALUES ('g0', 'chr0', 100), ('g1', 'chr1', 104)) AS v(locus, rname, at_) ON d.rname = v.rname AND abs(pos - at_) <= 3),
  t AS (SELECT *, unnest(regexp_extract_all(cs, '(:[0-9]+|[*][a-z]{{2}}|[+][a-z]+|-[a-z]+)')) AS tok, generate_subscripts(regexp_extract_all(cs, '(:[0-9]+|[*][a-z]{{2}}|[+][a-z]+|-[a-z]+)'), 1) AS i FROM n),
  l AS (SELECT *, left(tok, 1) AS k, CASE left(tok, 1) WHEN ':' THEN CAST(substr(tok, 2) AS INT) WHEN '*' THEN 1 ELSE length(tok) - 1 END AS n FROM t),
  p AS (SELECT *, pos + coalesce(sum(CASE WHEN k = '+' THEN 0 ELSE n END) OVER (PARTITION BY rid, locus ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM l),
  g AS (SELECT rid, locus, any_value(rname) AS chr, any_value(pos) AS start, any_value(cr) AS cr, any_value(ur) AS ur, any_value(cs) AS cs, any_value(cigar_str) AS cigar, any_value(seq) AS seq,
    coalesce(string_agg(CASE WHEN k IN ('+', '-') THEN concat(CAST(p AS STRING), tok) END, ':' ORDER BY i), 'wildtype') AS hallele, coalesce(string_agg(CASE WHEN k = '*' THEN concat(CAST(p AS STRING), tok) END, ':' ORDER BY i), 'NA') AS sallele FROM p GROUP BY 1, 2),
  c AS ({_CELL_DICTIONARY}), u AS ({_UMI_DICTIONARY})
  SELECT chr, start, cr, coalesce(c.corrected, 'NA') AS cb, ur, coalesce(u.corrected, 'NA') AS ub, concat(cr, ur) AS molid, cs, cigar, CASE WHEN cigar LIKE '%I%' THEN regexp_extract(cigar, '([0-9]+)I', 1) ELSE '0' END AS iv,
    CASE WHEN cigar LIKE '%D%' THEN regexp_extract(cigar, '([0-9]+)D', 1) ELSE '0' END AS dv, hallele, sallele, seq, locus FROM g LEFT JOIN c ON cr = c.raw LEFT JOIN u ON ur = u.raw""")
def cs_allele_table(t: Inputs) -> DataFrame:
    t.fx_cigar.createOrReplaceTempView("fx_cigar")
    t.fx_mols.createOrReplaceTempView("fx_mols")
    loci = t.spark.createDataFrame([("g0", "chr0", 100), ("g1", "chr1", 104)], "locus string, rname string, pos int")
    return a.cs_allele_table(t.spark.sql(_CS_READS), loci, 3, t.spark.sql(_CELL_DICTIONARY), t.spark.sql(_UMI_DICTIONARY))


@query("cigar_allele_string", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, concat(CAST(m AS STRING), op) AS allele FROM {_CG}")
def cigar_allele_string(t: Inputs) -> DataFrame:
    return a.cigar_allele_string(t.fx_cigar).drop("cigar_str")


_LONG = """(SELECT cbc AS cell, raw_ibar AS site, allele FROM (SELECT cbc, raw_ibar, allele, row_number() OVER (PARTITION BY cbc, raw_ibar ORDER BY n DESC, allele) AS k FROM
  (SELECT cbc, raw_ibar, CASE WHEN wt THEN 'wt' ELSE substr(seq, 1, 6) END AS allele, count(*) AS n FROM fx_mols GROUP BY 1, 2, 3) AS c) AS d WHERE k = 1) AS lng"""


def long(t: Inputs) -> DataFrame:
    return a.allele_long(t.fx_mols.withColumn("allele", F.when(F.col("wt"), "wt").otherwise(F.substring("seq", 1, 6))), "cbc", "raw_ibar", "allele")


def _coded(t: Inputs) -> DataFrame:
    return a.allele_codes(long(t))


_SITES = ", ".join(f"coalesce(max(CASE WHEN k = {k} THEN allele END), 'NA') AS s{k}" for k in range(1, 41))  # the fixture has 40 barcodes


@query("allele_matrix", f"""SELECT cell, {_SITES}
  FROM {_LONG} JOIN (SELECT site, row_number() OVER (ORDER BY site) AS k FROM (SELECT DISTINCT raw_ibar AS site FROM fx_mols) AS x) AS y USING (site) GROUP BY cell""")
def allele_matrix(t: Inputs) -> DataFrame:
    sites = [r.raw_ibar for r in t.fx_mols.select("raw_ibar").distinct().orderBy("raw_ibar").collect()]
    return a.allele_matrix(long(t), sites).withColumnsRenamed({s: f"s{i}" for i, s in enumerate(sites, 1)})


@query("allele_matrix_long", f"""SELECT cell, site, coalesce(allele, 'NA') AS allele FROM (SELECT DISTINCT cell FROM {_LONG}) AS c CROSS JOIN (SELECT DISTINCT site FROM {_LONG}) AS s LEFT JOIN {_LONG} USING (cell, site)""")
def allele_matrix_long(t: Inputs) -> DataFrame:
    return a.allele_matrix_long(long(t))


_CODES = f"(SELECT cell, site, CAST(dense_rank() OVER (ORDER BY allele) AS INT) AS code FROM {_LONG}) AS cds"


@query("allele_codes", f"SELECT * FROM {_CODES}")
def allele_codes(t: Inputs) -> DataFrame:
    return _coded(t)


@query("allele_similarity", f"""WITH c AS (SELECT * FROM {_CODES}), p AS (SELECT cell, string_agg(concat(site, ':', CAST(code AS STRING)), ',' ORDER BY site, code) AS profile FROM c GROUP BY 1),
  r AS (SELECT min(cell) AS cell FROM p GROUP BY profile), s AS (SELECT * FROM c WHERE code > 3 AND cell IN (SELECT cell FROM r))
  SELECT x.cell, y.cell AS other, CAST(count(*) * 4.0 AS DOUBLE) AS similarity FROM s AS x JOIN s AS y ON x.site = y.site AND x.code = y.code AND x.cell < y.cell GROUP BY 1, 2""")
def allele_similarity(t: Inputs) -> DataFrame:
    return a.allele_similarity(_coded(t), 2.0)


@query("indel_stats", f"""SELECT site, allele, n, round(n / sum(n) OVER (PARTITION BY site), 9) AS fraction, CAST(row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS INT) AS rank
  FROM (SELECT site, allele, count(*) AS n FROM {_LONG} GROUP BY 1, 2) AS c""")
def indel_stats(t: Inputs) -> DataFrame:
    return a.indel_stats(long(t)).withColumn("fraction", F.round("fraction", 9))


@query("lane_merge_filter", """WITH u AS (SELECT concat(cbc, CASE WHEN sample_id <= 'S1' THEN '-1' ELSE '-2' END) AS cell, umi, raw_ibar AS label FROM fx_mols)
  SELECT * FROM u WHERE label IN (SELECT label FROM u GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 3)""")
def lane_merge_filter(t: Inputs) -> DataFrame:
    m = t.fx_mols.select(F.col("cbc").alias("cell"), "umi", F.col("raw_ibar").alias("label"), "sample_id")
    return a.lane_merge_filter([m.where(f"sample_id {op} 'S1'").drop("sample_id") for op in ("<=", ">")], top_labels=3)


_CHARS = f"""(SELECT cell, site, state FROM (SELECT *, max(n) OVER (PARTITION BY site) / sum(CASE WHEN k1 = 1 THEN n END) OVER (PARTITION BY site) AS top FROM (SELECT *, count(*) OVER (PARTITION BY site, state) AS n, row_number() OVER (PARTITION BY site, state) AS k1 FROM
  (SELECT cell, site, CAST(CASE WHEN allele = 'wt' THEN 0 ELSE dense_rank() OVER (PARTITION BY site, allele = 'wt' ORDER BY allele) END AS INT) AS state FROM {_LONG}) AS a) AS b) AS c WHERE top <= 0.7) AS chars"""


@query("character_matrix", f"SELECT * FROM {_CHARS}")
def character_matrix(t: Inputs) -> DataFrame:
    return a.character_matrix(long(t), 0.7).select("cell", "site", "state")


@query("top_allele_contrast", """SELECT cbc, raw_ibar, coalesce(max(CASE WHEN wt THEN n END), 0) AS umis_wt, coalesce(max(CASE WHEN NOT wt THEN n END), 0) AS umis_cut,
  round(log10(1 + coalesce(max(CASE WHEN wt THEN n END), 0)), 9) AS log_wt, round(log10(1 + coalesce(max(CASE WHEN NOT wt THEN n END), 0)), 9) AS log_cut
  FROM (SELECT cbc, raw_ibar, wt, seq, count(DISTINCT umi) AS n FROM fx_mols GROUP BY 1, 2, 3, 4) AS x GROUP BY 1, 2""")
def top_allele_contrast(t: Inputs) -> DataFrame:
    return a.top_allele_contrast(t.fx_mols).withColumns({c: F.round(c, 9) for c in ("log_wt", "log_cut")})


@query("bin_alleles")
def bin_alleles(t: Inputs) -> DataFrame:
    cut = F.regexp_extract("r2_seq", "(CATCTTAGTCATTAC.*GACAGGTGTTCGTTG)", 1)
    r = t.fx_reads.select(F.substring("r1_seq", 1, 12).alias("umi"), cut.alias("seq"))
    return composite.bin_alleles(r, "CATCTTAGTCATTACGACAGGTGTTCGTTG", [("left", 0, 12), ("cut", 13, 17), ("right", 18, 29)], "CATCTTAG", "TGTTCGTTG", min_reads=2)
