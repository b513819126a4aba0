"""Queries of the guide-molecule operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ibars as i
from .registry import Inputs, query


def _encoded_sql() -> str:
    sql = "SELECT *, seq AS oseq FROM fx_guides"
    for k, (pattern, token, _) in enumerate(i.encode_rules()):
        if k == 3:
            sql = f"SELECT *, CASE WHEN regexp_matches(seq, '{i.RAW_IBAR}') THEN regexp_extract(seq, '{i.RAW_IBAR}', 1) END AS raw_ibar FROM ({sql}) AS e"
        sql = f"SELECT * REPLACE (regexp_replace(seq, '{pattern}', '{token}', 'g') AS seq) FROM ({sql}) AS e"
    return f"(SELECT *, len(regexp_extract_all(seq, 'WT')) = 1 AND regexp_matches(seq, '{i.WT_PATTERN}') AS wt FROM ({sql}) AS e) AS enc"


_ENC = _encoded_sql()


def encoded(t: Inputs) -> DataFrame:
    return i.encode_reads(t.fx_guides)


@query("encode_reads", f"SELECT cbc, umi, seq, oseq, raw_ibar, wt FROM {_ENC}")
def encode_reads(t: Inputs) -> DataFrame:
    return encoded(t).select("cbc", "umi", "seq", "oseq", "raw_ibar", "wt")


_MOL = f"""(SELECT cbc, umi, raw_ibar, CAST(umi_reads AS BIGINT) AS umi_reads, n AS umi_dom_reads, seq, oseq FROM (SELECT *, sum(n) OVER w AS umi_reads, max(n) OVER w AS top, row_number() OVER (PARTITION BY cbc, umi, raw_ibar ORDER BY n DESC, seq DESC) AS k,
  count(*) OVER (PARTITION BY cbc, umi, raw_ibar, n) AS same FROM (SELECT cbc, umi, raw_ibar, seq, count(*) AS n, min(oseq) AS oseq FROM {_ENC} WHERE raw_ibar IS NOT NULL GROUP BY 1, 2, 3, 4) AS c
  WINDOW w AS (PARTITION BY cbc, umi, raw_ibar)) AS d WHERE k = 1 AND same = 1) AS mol"""


@query("ibar_molecules", f"SELECT * FROM {_MOL}")
def ibar_molecules(t: Inputs) -> DataFrame:
    return i.ibar_molecules(encoded(t))


def _spacers(t: Inputs) -> DataFrame:
    """The whitelist of spacers."""
    return t.fx_mols.where("cluster <> 3").select("spacer").distinct()


_WL = "(SELECT '(' || string_agg(spacer, '|' ORDER BY spacer) || ')' AS p FROM (SELECT DISTINCT spacer FROM fx_mols WHERE cluster <> 3) AS d)"
_REST = r"regexp_replace(regexp_replace(seq, 'CTAGA.+?$', '', 'g'), '\[···(TSO|CNSCFL|bU6)···\]', '', 'g')"
_SP = f"(SELECT e.*, CASE WHEN regexp_matches(seq, p) THEN regexp_extract(seq, p, 1) ELSE {_REST} END AS spacer FROM {_ENC.replace(' AS enc', ' AS e')}, {_WL} AS w) AS sp"


@query("extract_spacer", f"SELECT cbc, umi, seq, spacer FROM {_SP}")
def extract_spacer(t: Inputs) -> DataFrame:
    return i.extract_spacer(encoded(t), _spacers(t)).select("cbc", "umi", "seq", "spacer")


@query("wt_encode_mask", f"SELECT cbc, umi, seq, len(regexp_extract_all(seq, 'WT')) = 1 AND regexp_matches(seq, '{i.WT_PATTERN}') AS wt FROM (SELECT cbc, umi, regexp_replace(seq, p, '[···WT···]', 'g') AS seq FROM {_ENC}, {_WL} AS w) AS x")
def wt_encode_mask(t: Inputs) -> DataFrame:
    return i.mask_wt(i.encode_wt(encoded(t), _spacers(t))).select("cbc", "umi", "seq", "wt")


_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(seq, '{p}')) AS INT) AS {c}" for c, p in i.COUNTED.items())


@query("pattern_counts", f"SELECT cbc, umi, {_COUNTS} FROM {_ENC}")
def pattern_counts(t: Inputs) -> DataFrame:
    return i.pattern_counts(encoded(t)).select("cbc", "umi", *i.COUNTED)


@query("noise_spectrum", f"""SELECT np_can, {', '.join(f'round(100 * count(*) FILTER (WHERE np_tsos = {v}) / (SELECT count(*) FROM fx_guides), 9) AS np_tsos_{v}' for v in (0, 1, 2))} FROM (SELECT {_COUNTS} FROM {_ENC}) AS c GROUP BY 1""")
def noise_spectrum(t: Inputs) -> DataFrame:
    return i.noise_spectrum(i.pattern_counts(encoded(t)), "np_can", "np_tsos", [0, 1, 2])


@query("reads_to_molecules", f"""WITH s AS (SELECT m.*, CASE WHEN regexp_matches(seq, p) THEN regexp_extract(seq, p, 1) ELSE {_REST} END AS spacer, regexp_replace(seq, p, '[···WT···]', 'g') AS wseq FROM {_MOL.replace(' AS mol', ' AS m')}, {_WL} AS w),
  k AS (SELECT * FROM s WHERE NOT contains(raw_ibar, 'N') AND NOT contains(spacer, 'N') AND NOT contains(umi, 'N'))
  SELECT cbc, umi, raw_ibar, spacer, wseq AS seq, umi_reads, (SELECT count(DISTINCT umi) FROM k AS y WHERE y.cbc = k.cbc AND y.raw_ibar = k.raw_ibar AND y.wseq = k.wseq) AS umis_allele,
    (SELECT count(DISTINCT wseq) FROM k AS y WHERE y.cbc = k.cbc AND y.raw_ibar = k.raw_ibar) AS n_sib FROM k""")
def reads_to_molecules(t: Inputs) -> DataFrame:
    return i.reads_to_molecules(t.fx_guides, _spacers(t)).select("cbc", "umi", "raw_ibar", "spacer", "seq", "umi_reads", "umis_allele", "n_sib")


_HAM = "(SELECT count(*) FROM range(1, 7) AS g(i) WHERE substr(x.raw_ibar, i, 1) <> substr(y.raw_ibar, i, 1))"


@query("valid_ibars", f"""WITH n AS (SELECT raw_ibar, count(DISTINCT cbc) AS cells, count(*) AS mols FROM fx_mols GROUP BY 1 HAVING count(DISTINCT cbc) > 5 AND count(*) > 5 AND NOT contains(raw_ibar, 'N'))
  SELECT * FROM n AS x WHERE NOT EXISTS (SELECT 1 FROM n AS y WHERE (y.mols > x.mols OR y.mols = x.mols AND y.raw_ibar > x.raw_ibar) AND {_HAM} <= 3)""")
def valid_ibars(t: Inputs) -> DataFrame:
    return i.valid_ibars(t.fx_mols, 5, 5, 3)


@query("prefixed_ibar", "SELECT concat(raw_ibar, '.', substr(spacer, 3, 5)) AS pibar, count(*) AS mols FROM fx_mols WHERE wt GROUP BY 1 HAVING count(*) > 20")
def prefixed_ibar(t: Inputs) -> DataFrame:
    return i.prefixed_ibar(t.fx_mols, 3, 5, 20)


@query("umi_coverage_filter", """WITH n AS (SELECT cbc AS umi, count(*) AS n FROM fx_mols GROUP BY 1) SELECT cbc AS umi, raw_ibar FROM fx_mols WHERE cbc IN (SELECT umi FROM n WHERE n >= (SELECT quantile_cont(n, 0.75) FROM n))""")
def umi_coverage_filter(t: Inputs) -> DataFrame:
    return i.umi_coverage_filter(t.fx_mols.select(F.col("cbc").alias("umi"), "raw_ibar"), quantile=0.75)


@query("molecule_consensus_split", """WITH r AS (SELECT cbc, CASE WHEN cluster = 3 THEN NULL ELSE raw_ibar END AS raw_ibar, umi, CASE WHEN instr(seq, 'AC') > 0 THEN substr(seq, instr(seq, 'AC')) ELSE seq END AS seq FROM fx_mols),
  n AS (SELECT *, row_number() OVER (PARTITION BY cbc, raw_ibar, umi ORDER BY n DESC, seq) AS k, sum(n) OVER (PARTITION BY cbc, raw_ibar, umi) AS reads FROM (SELECT cbc, raw_ibar, umi, seq, count(*) AS n FROM r GROUP BY 1, 2, 3, 4) AS c)
  SELECT cbc, raw_ibar, umi, seq, CAST(reads AS BIGINT) AS reads, CASE WHEN raw_ibar IS NULL THEN 'no_ibar' WHEN raw_ibar IN (SELECT raw_ibar FROM fx_mols WHERE cluster = 1) THEN 'expected' ELSE 'unexpected' END AS label FROM n WHERE k = 1""")
def molecule_consensus_split(t: Inputs) -> DataFrame:
    r = t.fx_mols.select("cbc", F.when(F.col("cluster") != 3, F.col("raw_ibar")).alias("raw_ibar"), "umi", "seq")
    return i.molecule_consensus_split(r, t.fx_mols.where("cluster = 1"), "AC")


_META = "(SELECT raw_ibar, min(cluster) AS meta_cluster FROM fx_mols GROUP BY 1)"


@query("annotate_ibars", f"""WITH n AS (SELECT raw_ibar, seq AS spacer, count(*) AS n FROM fx_mols GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY raw_ibar ORDER BY n DESC, spacer) AS INT) AS rank FROM n WHERE n >= (SELECT quantile_cont(n, 0.55) FROM n))
  SELECT k.*, meta_cluster FROM k LEFT JOIN {_META} AS m USING (raw_ibar) WHERE rank <= 2""")
def annotate_ibars(t: Inputs) -> DataFrame:
    m = t.fx_mols.drop("spacer").withColumnRenamed("seq", "spacer")
    return i.annotate_ibars(m, t.fx_mols.groupBy("raw_ibar").agg(F.min("cluster").alias("meta_cluster")))


@query("empirical_annotation", """WITH n AS (SELECT sample_id, raw_ibar, seq AS spacer, count(*) AS n FROM fx_mols GROUP BY 1, 2, 3), k AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY sample_id, raw_ibar ORDER BY n DESC) AS k FROM n) AS x WHERE k <= 1)
  SELECT sample_id, raw_ibar, spacer, n, round(nlen, 9) AS nlen, clone FROM (SELECT *, 1e4 * n / sum(n) OVER (PARTITION BY sample_id) AS nlen FROM k) AS y JOIN (SELECT seq AS spacer, min(cluster) AS clone FROM fx_mols WHERE wt GROUP BY 1) AS w USING (spacer)""")
def empirical_annotation(t: Inputs) -> DataFrame:
    m = t.fx_mols.drop("spacer").withColumnRenamed("seq", "spacer")
    meta = m.where("wt").groupBy("spacer").agg(F.min("cluster").alias("clone"))
    return i.empirical_annotation(m, meta).withColumn("nlen", F.round("nlen", 9))


_QC = """(SELECT sample_id, raw_ibar, ibar_reads, ibar_umis, ibar_readsg, ibar_umisg, round(log10(ibar_umis), 9) AS log_umis, round(ibar_umis / su, 9) AS umi_share, round(-log10(ibar_umis / su), 9) AS neg_log_share FROM
  (SELECT *, sum(ibar_umis) OVER (PARTITION BY sample_id) AS su FROM (SELECT sample_id, raw_ibar, CAST(sum(umi_reads) AS BIGINT) AS ibar_reads, count(DISTINCT umi) AS ibar_umis FROM fx_mols GROUP BY 1, 2) AS p) AS q JOIN
  (SELECT raw_ibar, CAST(sum(DISTINCT ibar_reads) AS BIGINT) AS ibar_readsg, CAST(sum(DISTINCT ibar_umis) AS BIGINT) AS ibar_umisg FROM (SELECT sample_id, raw_ibar, sum(umi_reads) AS ibar_reads, count(DISTINCT umi) AS ibar_umis FROM fx_mols GROUP BY 1, 2) AS p GROUP BY 1) AS g USING (raw_ibar)) AS qc"""


def _qc(t: Inputs) -> DataFrame:
    return i.ibar_qc(t.fx_mols).withColumns({c: F.round(c, 9) for c in ("log_umis", "umi_share", "neg_log_share")})


@query("ibar_qc", f"SELECT * FROM {_QC}")
def ibar_qc(t: Inputs) -> DataFrame:
    return _qc(t)


@query("ibar_filter", f"SELECT sample_id, raw_ibar, ibar_umis FROM {_QC} WHERE ibar_umisg >= 80 AND ibar_umis >= 20 AND raw_ibar IN (SELECT raw_ibar FROM fx_mols WHERE cluster < 3)")
def ibar_filter(t: Inputs) -> DataFrame:
    return i.ibar_filter(_qc(t), 80, 20, t.fx_mols.where("cluster < 3")).select("sample_id", "raw_ibar", "ibar_umis")


@query("ibar_screen", """SELECT * FROM (SELECT clone, raw_ibar, mols, CAST(dense_rank() OVER (PARTITION BY clone ORDER BY mols DESC) AS INT) AS rank FROM (SELECT coalesce(clone, 'unknown') AS clone, raw_ibar, count(*) AS mols FROM fx_mols LEFT JOIN
  (SELECT raw_ibar, concat('c', CAST(min(cluster) AS STRING)) AS clone FROM fx_mols WHERE cluster < 3 AND right(raw_ibar, 1) <> 'A' GROUP BY 1) AS c USING (raw_ibar) GROUP BY 1, 2) AS n) AS z WHERE rank <= 5""")
def ibar_screen(t: Inputs) -> DataFrame:
    c = t.fx_mols.where("cluster < 3 and right(raw_ibar, 1) <> 'A'").groupBy("raw_ibar").agg(F.concat(F.lit("c"), F.min("cluster").cast("string")).alias("clone"))
    return i.ibar_screen(t.fx_mols, c, 5)


@query("stacked_fractions", """SELECT sample_id, raw_ibar, seq, n, CAST(k AS INT) AS k, round(freq, 9) AS freq, round(coalesce(sum(freq) OVER (PARTITION BY sample_id, raw_ibar ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS "offset" FROM
  (SELECT *, n / sum(n) OVER (PARTITION BY sample_id, raw_ibar) AS freq, row_number() OVER (PARTITION BY sample_id, raw_ibar ORDER BY n DESC, seq) AS k FROM (SELECT sample_id, raw_ibar, seq, count(*) AS n FROM fx_mols GROUP BY 1, 2, 3) AS c) AS d WHERE k <= 3""")
def stacked_fractions(t: Inputs) -> DataFrame:
    return i.stacked_fractions(t.fx_mols, ["sample_id", "raw_ibar"], 3).withColumns({c: F.round(c, 9) for c in ("freq", "offset")})


@query("qc_stats_by_sample", " UNION ALL ".join(f"SELECT sample_id, concat('label_', sample_id) AS label, '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM fx_mols GROUP BY 1" for n, e in {
    "molecules": "count(*)", "umis": "count(DISTINCT umi)", "cells": "count(DISTINCT cbc)", "reads_per_umi": "round(avg(umi_reads), 9)"}.items()))
def qc_stats_by_sample(t: Inputs) -> DataFrame:
    meta = t.fx_mols.select("sample_id").distinct().withColumn("label", F.concat(F.lit("label_"), "sample_id"))
    return i.qc_stats_by_sample(t.fx_mols, meta).withColumn("value", F.round("value", 9))


@query("sibling_noise", """SELECT *, seq = first_value(seq) OVER (PARTITION BY cbc, raw_ibar ORDER BY umis DESC, seq DESC) AS is_top FROM
  (SELECT cbc, raw_ibar, seq, count(DISTINCT umi) AS umis, count(*) OVER (PARTITION BY cbc, raw_ibar) AS siblings FROM fx_mols GROUP BY 1, 2, 3) AS n""")
def sibling_noise(t: Inputs) -> DataFrame:
    return i.sibling_noise(t.fx_mols)


@query("allele_calling", """WITH p AS (SELECT doublet_prediction, cbc, raw_ibar, seq, count(*) AS n, max(umi_dom_reads) AS norm, max(umi_reads) AS r FROM fx_mols GROUP BY 1, 2, 3, 4),
  q AS (SELECT *, max(n) OVER (PARTITION BY doublet_prediction, cbc, raw_ibar) AS top FROM p)
  SELECT doublet_prediction, cbc, raw_ibar, CAST(sum(n) AS BIGINT) AS umis_per_ibar, max(n) AS umis_top_allele, count(*) AS siblings, max(norm) AS norm_counts, arg_max(seq, struct_pack(a := n, b := seq)) AS top_allele_raw,
  arg_max(seq, struct_pack(a := norm, b := seq)) AS top_allele_norm, max(r) AS umi_reads, CAST(count(*) FILTER (WHERE n = top) - 1 AS DOUBLE) AS ties FROM q GROUP BY 1, 2, 3""")
def allele_calling(t: Inputs) -> DataFrame:
    return i.allele_calling(t.fx_mols.withColumn("norm_counts", F.col("umi_dom_reads"))).drop("umi_dom_reads")


@query("normalize_mols", """SELECT umi, cbc, raw_ibar, seq, umis_per_cell, total_umis, total_umis_ibar, umis_allele, round(umis_allele * (umis_per_cell / total_umis) * (total_umis_ibar / total_umis), 12) AS weighted_counts FROM
  (SELECT *, count(*) OVER (PARTITION BY cbc) AS umis_per_cell, count(*) OVER () AS total_umis, count(*) OVER (PARTITION BY raw_ibar) AS total_umis_ibar, count(*) OVER (PARTITION BY cbc, raw_ibar, seq) AS umis_allele FROM fx_mols WHERE doublet_prediction = 'singlet') AS s""")
def normalize_mols(t: Inputs) -> DataFrame:
    return i.normalize_mols(t.fx_mols).select("umi", "cbc", "raw_ibar", "seq", "umis_per_cell", "total_umis", "total_umis_ibar", "umis_allele", F.round("weighted_counts", 12).alias("weighted_counts"))


@query("clonal_composition", "SELECT cbc, " + ", ".join(f"count(*) FILTER (WHERE cluster = {c}) AS ibc_{c}" for c in (1, 2, 3)) + " FROM fx_mols GROUP BY 1")
def clonal_composition(t: Inputs) -> DataFrame:
    return i.clonal_composition(t.fx_mols, [1, 2, 3])


@query("clone_scores", """SELECT cbc, mols_per_cell, round(log10(m2 / m1), 9) AS score_raw, round(log10(i2 / i1), 9) AS score_ints, round(log10((m2 / m1) / (i2 / i1)), 9) AS score_norm,
  CASE WHEN log10((m2 / m1) / (i2 / i1)) < 0 THEN 'left' WHEN log10((m2 / m1) / (i2 / i1)) < 0.25 THEN 'mid' ELSE 'right' END AS clone FROM (SELECT cbc, count(*) AS mols_per_cell, count(*) FILTER (WHERE cluster = 1) AS m1, count(*) FILTER (WHERE cluster = 2) AS m2,
  count(DISTINCT CASE WHEN cluster = 1 THEN raw_ibar END) AS i1, count(DISTINCT CASE WHEN cluster = 2 THEN raw_ibar END) AS i2 FROM fx_mols WHERE doublet_prediction = 'singlet' GROUP BY 1) AS n WHERE m1 > 0 AND m2 > 0""")
def clone_scores(t: Inputs) -> DataFrame:
    return i.clone_scores(t.fx_mols).select("cbc", "mols_per_cell", *(F.round(c, 9).alias(c) for c in ("score_raw", "score_ints", "score_norm")), "clone")


@query("annotate_cells", "SELECT cbc, umi, ann AS cluster FROM fx_mols LEFT JOIN (SELECT cbc, max(cluster) AS ann FROM fx_mols WHERE wt AND sample_id = 'S1' GROUP BY 1) AS a USING (cbc)")
def annotate_cells(t: Inputs) -> DataFrame:
    ann = t.fx_mols.where("wt and sample_id = 'S1'").groupBy("cbc").agg(F.max("cluster").alias("cluster"))
    return i.annotate_cells(t.fx_mols.select("cbc", "umi", "cluster"), ann)


@query("clone_pairs", """WITH e AS (SELECT DISTINCT cbc, raw_ibar FROM fx_mols), k AS (SELECT * FROM e WHERE raw_ibar IN (SELECT raw_ibar FROM e GROUP BY 1 HAVING count(*) >= 95))
  SELECT x.raw_ibar AS a, y.raw_ibar AS b, count(*) AS cells, round(1 / (1 + count(*)), 9) AS distance FROM k AS x JOIN k AS y ON x.cbc = y.cbc AND x.raw_ibar < y.raw_ibar GROUP BY 1, 2""")
def clone_pairs(t: Inputs) -> DataFrame:
    return i.clone_pairs(t.fx_mols, 95).withColumn("distance", F.round("distance", 9))


#: A row a read: UMIs of one letter and a sample, so that they hold many.
_CLONE_READS = "SELECT cbc, concat(substr(umi, 1, 1), sample_id) AS umi, raw_ibar, umi AS read FROM fx_mols"


def _clone_sql(cells: str) -> str:
    return f"""WITH r AS ({_CLONE_READS}), c AS ({cells}), k AS (SELECT *, row_number() OVER (PARTITION BY cbc, umi ORDER BY read, raw_ibar) AS k FROM r WHERE cbc IN (SELECT cbc FROM c)),
  e AS (SELECT DISTINCT cbc, raw_ibar FROM k WHERE k <= 30) SELECT x.raw_ibar AS a, y.raw_ibar AS b, count(*) AS cells, round(1 / (1 + count(*)), 9) AS distance FROM e AS x JOIN e AS y ON x.cbc = y.cbc AND x.raw_ibar < y.raw_ibar GROUP BY 1, 2"""


@query("clone_pairs_top_cells", _clone_sql("SELECT cbc FROM r GROUP BY 1 ORDER BY count(DISTINCT umi) DESC, cbc LIMIT 50"))
def clone_pairs_top_cells(t: Inputs) -> DataFrame:
    t.fx_mols.createOrReplaceTempView("fx_mols")
    return i.clone_pairs(t.spark.sql(_CLONE_READS), top_cells=50, reads_per_umi=30, order="read").withColumn("distance", F.round("distance", 9))


@query("clone_pairs_whitelist", _clone_sql("SELECT DISTINCT cbc FROM fx_mols WHERE wt AND cluster = 1 AND doublet_prediction = 'singlet'"))
def clone_pairs_whitelist(t: Inputs) -> DataFrame:
    t.fx_mols.createOrReplaceTempView("fx_mols")
    cells = t.fx_mols.where("wt and cluster = 1 and doublet_prediction = 'singlet'")
    return i.clone_pairs(t.spark.sql(_CLONE_READS), whitelist=cells, reads_per_umi=30, order="read").withColumn("distance", F.round("distance", 9))


@query("ibar_correlation_groups", """WITH RECURSIVE x AS (SELECT cbc, raw_ibar, CAST(count(*) AS DOUBLE) AS x FROM fx_mols WHERE wt GROUP BY 1, 2),
  s AS (SELECT raw_ibar, sum(x) AS s, sum(x * x) AS ss FROM x GROUP BY 1 HAVING count(*) >= 10), n AS (SELECT CAST(count(DISTINCT cbc) AS DOUBLE) AS n FROM x),
  xy AS (SELECT p.raw_ibar AS a, q.raw_ibar AS b, sum(p.x * q.x) AS sxy FROM x AS p JOIN x AS q ON p.cbc = q.cbc AND p.raw_ibar < q.raw_ibar GROUP BY 1, 2),
  e AS (SELECT a, b FROM xy JOIN s AS sa ON sa.raw_ibar = a JOIN s AS sb ON sb.raw_ibar = b, n WHERE (n * sxy - sa.s * sb.s) / sqrt((n * sa.ss - sa.s * sa.s) * (n * sb.ss - sb.s * sb.s)) >= 0.05),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, a AS reach FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.reach = u.a),
  g AS (SELECT a, min(reach) AS root FROM r GROUP BY 1), z AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS grp FROM g GROUP BY 1)
  SELECT s.raw_ibar, CAST(coalesce(grp, -1) AS INT) AS grp FROM s LEFT JOIN g ON g.a = s.raw_ibar LEFT JOIN z USING (root)""")
def ibar_correlation_groups(t: Inputs) -> DataFrame:
    return i.ibar_correlation_groups(t.fx_mols, 10, 0.05)


@query("clone_filter", """WITH n AS (SELECT cbc, cluster, count(*) AS n FROM fx_mols GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cbc ORDER BY n DESC, cluster) AS k FROM n)
  SELECT cbc, string_agg(CAST(cluster AS STRING), ',' ORDER BY cluster) AS clusters, count(*) AS n_clusters, max(CASE WHEN k = 1 THEN cluster END) AS top_cluster, max(CASE WHEN k = 1 THEN n END) AS rank1, coalesce(max(CASE WHEN k = 2 THEN n END), 0) AS rank2 FROM r GROUP BY 1""")
def clone_filter(t: Inputs) -> DataFrame:
    return i.clone_filter(t.fx_mols, 0.1)


@query("genotype_table", """WITH n AS (SELECT raw_ibar, seq, count(*) AS n FROM fx_mols GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY raw_ibar ORDER BY n DESC, seq) AS k FROM n)
  SELECT raw_ibar, max(CASE WHEN k = 1 THEN seq END) AS top1, max(CASE WHEN k = 2 THEN seq END) AS top2, CAST(round(sum(n) / max(n)) AS INT) AS cases FROM r GROUP BY 1""")
def genotype_table(t: Inputs) -> DataFrame:
    return i.genotype_table(t.fx_mols, "raw_ibar", "seq", 2)


_LINE = "concat(umi, ' ', raw_ibar, ' chr', CAST(cluster AS STRING), ':', CAST(umi_reads * 1000 + length(seq) * umi_dom_reads AS STRING), ',chr', CAST(cluster % 2 AS STRING), ':', CAST(umi_dom_reads AS STRING))"
_HITS = f"""l AS (SELECT {_LINE} AS value FROM fx_mols), h AS (SELECT split_part(value, ' ', 2) AS ibar, unnest(string_split(split_part(value, ' ', 3), ',')) AS at_ FROM l),
  p AS (SELECT ibar, split_part(at_, ':', 1) AS chrom, CAST(split_part(at_, ':', 2) AS BIGINT) AS start FROM h), d AS (SELECT DISTINCT * FROM p),
  m AS (SELECT ibar, chrom, count(*) AS points, quantile_cont(start, 0.5) AS median_start FROM d GROUP BY 1, 2)"""


@query("integration_coords", f"""WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY ibar ORDER BY points DESC, chrom DESC) AS k, sum(points) OVER (PARTITION BY ibar) AS total FROM m)
  SELECT ibar, chrom, points, median_start, round(points / total, 9) AS share FROM k WHERE k = 1 AND points > 5""")
def integration_coords(t: Inputs) -> DataFrame:
    return i.integration_coords(t.fx_mols.selectExpr(f"{_LINE} as value"), 5).withColumn("share", F.round("share", 9))


@query("integration_coords_all", f"""WITH {_HITS}, c AS (SELECT ibar, chrom, count(*) AS hits FROM p GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY ibar ORDER BY hits DESC, chrom) AS k, sum(hits) OVER (PARTITION BY ibar) AS total, max(hits) OVER (PARTITION BY ibar) AS top FROM c)
  SELECT ibar, chrom, points, median_start, round(hits / total, 9) AS share FROM k JOIN m USING (ibar, chrom) WHERE k <= round(total / top) AND points > 5""")
def integration_coords_all(t: Inputs) -> DataFrame:
    return i.integration_coords(t.fx_mols.selectExpr(f"{_LINE} as value"), 5, all_top=True).withColumn("share", F.round("share", 9))


_CONTACTS = ("CASE WHEN wt THEN 'Lin' ELSE '1' END AS chr1", "umi_reads AS start1", "CASE WHEN cluster = 1 THEN 'Lin' ELSE CAST(cluster AS STRING) END AS chr2", "umi_reads * 1000 AS start2", "umi AS mol")


@query("contacts_to_cis", f"""SELECT concat('chr', chr2) AS chrom1, CAST(start2 AS BIGINT) AS start1, CAST(start2 + 1 AS BIGINT) AS end1, concat('chr', chr2) AS chrom2, start2, CAST(start2 + 1 AS BIGINT) AS end2, mol
  FROM (SELECT {", ".join(_CONTACTS)} FROM fx_mols) AS c WHERE chr1 = 'Lin' AND chr2 <> 'Lin'""")
def contacts_to_cis(t: Inputs) -> DataFrame:
    return i.contacts_to_cis(t.fx_mols.selectExpr(*_CONTACTS))


@query("clone_table", """WITH m AS (SELECT *, substr(seq, 1, 6) AS allele FROM fx_mols), n AS (SELECT CAST(count(DISTINCT cbc) AS DOUBLE) AS n FROM m),
  k AS (SELECT raw_ibar, count(DISTINCT cbc) / n AS clone_size FROM m, n GROUP BY raw_ibar, n), z AS (SELECT cbc, count(DISTINCT umi) AS csize FROM m GROUP BY 1),
  j AS (SELECT m.*, clone_size FROM m JOIN k USING (raw_ibar) WHERE clone_size >= 0.05), a AS (SELECT allele, cbc, raw_ibar, count(DISTINCT umi) AS allele_umis FROM j GROUP BY 1, 2, 3)
  SELECT cbc, umi, raw_ibar, allele, contains(seq, 'AC') AND contains(seq, 'GT') AS ot, csize, round(clone_size, 9) AS clone_size, allele_umis FROM j JOIN z USING (cbc) JOIN a USING (allele, cbc, raw_ibar)""")
def clone_table(t: Inputs) -> DataFrame:
    out = i.clone_table(t.fx_mols.withColumn("allele", F.substring("seq", 1, 6)), "AC", "GT", 0.05)
    return out.select("cbc", "umi", "raw_ibar", "allele", "ot", "csize", F.round("clone_size", 9).alias("clone_size"), "allele_umis")


@query("valid_ibars_share", f"""WITH n AS (SELECT raw_ibar, count(DISTINCT cbc) AS cells, count(*) AS mols FROM fx_mols GROUP BY 1 HAVING count(DISTINCT cbc) > CAST(0.1 AS DOUBLE) * (SELECT count(DISTINCT cbc) FROM fx_mols) AND count(*) > 5 AND NOT contains(raw_ibar, 'N'))
  SELECT * FROM n AS x WHERE NOT EXISTS (SELECT 1 FROM n AS y WHERE (y.mols > x.mols OR y.mols = x.mols AND y.raw_ibar > x.raw_ibar) AND {_HAM} <= 3)""")
def valid_ibars_share(t: Inputs) -> DataFrame:
    return i.valid_ibars(t.fx_mols, 0.1, 5, 3, fraction=True)
