"""Queries of multi-site, QC, metrics and tree operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import fuzzy_pattern
from ..operators import multisite as m
from ..operators import qc as q
from ..operators import reads as r
from ..operators import trees as tr
from .constants import ANCHOR, END, METAS, START
from .registry import Inputs, query

_ID = f"(?:{fuzzy_pattern(START)})(.{{14}})(?:{fuzzy_pattern(METAS['META01'])})"


@query("integration_detect", f"""WITH n AS (SELECT regexp_extract(r2_seq, '{_ID}', 1) AS intid, count(*) AS n FROM fx_reads WHERE regexp_matches(r2_seq, '{_ID}') GROUP BY 1)
  SELECT * FROM n WHERE floor(log10(n)) > (SELECT floor(log10(max(n))) FROM n) - 1""")
def integration_detect(t: Inputs) -> DataFrame:
    return m.integration_detect(t.fx_reads, "r2_seq", START, 14, METAS["META01"])


_PAIRS = "(SELECT umi, raw_ibar AS intid1, substr(seq, 1, 6) AS intid2 FROM fx_mols) AS prs"


def _pairs(t: Inputs) -> DataFrame:
    return t.fx_mols.select("umi", F.col("raw_ibar").alias("intid1"), F.substring("seq", 1, 6).alias("intid2"))


_VALID = f"(SELECT * FROM (SELECT *, max(umis) OVER () AS best FROM (SELECT intid1, intid2, count(DISTINCT umi) AS umis FROM {_PAIRS} GROUP BY 1, 2) AS n) AS v WHERE log10(umis) >= log10(best) - 0.3) AS vp"


@query("valid_pairs", f"SELECT intid1, intid2, umis FROM {_VALID}")
def valid_pairs(t: Inputs) -> DataFrame:
    return m.valid_pairs(_pairs(t), 0.3)


_NEAR = """(SELECT raw, id FROM (SELECT raw, id, row_number() OVER (PARTITION BY raw ORDER BY d, id) AS k FROM (SELECT raw, id, (SELECT count(*) FROM range(1, 7) AS g(i) WHERE substr(raw, i, 1) <> substr(id, i, 1)) AS d FROM
  (SELECT DISTINCT intid{k} AS raw FROM p) AS a, (SELECT DISTINCT intid{k} AS id FROM v) AS b) AS c WHERE d <= 3) AS z WHERE k = 1)"""


@query("split_by_integration", f"""WITH p AS (SELECT * FROM {_PAIRS}), v AS (SELECT intid1, intid2 FROM {_VALID})
  SELECT umi, p.intid1, p.intid2, CASE WHEN v.intid1 IS NOT NULL THEN concat(a.id, ':', b.id) WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'chimeric' ELSE 'undetermined' END AS class
  FROM p LEFT JOIN {_NEAR.format(k=1)} AS a ON a.raw = p.intid1 LEFT JOIN {_NEAR.format(k=2)} AS b ON b.raw = p.intid2 LEFT JOIN v ON v.intid1 = a.id AND v.intid2 = b.id""")
def split_by_integration(t: Inputs) -> DataFrame:
    return m.split_by_integration(_pairs(t), m.valid_pairs(_pairs(t), 0.3)).select("umi", "intid1", "intid2", "class")


@query("sample_sheet", """WITH p AS (SELECT regexp_extract(id, '^PO_([0-9]+)', 1) AS primer, primer_end, substr(regexp_extract(upper(seq), 'GGCGACCACCGA(.+?)ACACTCTTTCC', 1), 1, 8) AS idx, plate FROM fx_plates)
  SELECT plate, a.primer AS i5_id, reverse(translate(a.idx, 'ACGT', 'TGCA')) AS index2, b.primer AS i7_id, reverse(translate(b.idx, 'ACGT', 'TGCA')) AS "index" FROM p AS a JOIN p AS b USING (plate)
  WHERE a.primer_end = 'i5' AND b.primer_end = 'i7'""")
def sample_sheet(t: Inputs) -> DataFrame:
    return m.sample_sheet(t.fx_plates, "GGCGACCACCGA", "ACACTCTTTCC", i5_rc=True, plate="plate")


@query("sample_sheet_plates", """WITH p AS (SELECT plate, regexp_extract(id, '^PO_([0-9]+)', 1) AS primer, primer_end, substr(regexp_extract(upper(seq), 'GGCGACCACCGA(.+?)ACACTCTTTCC', 1), 1, 8) AS idx FROM fx_plates)
  SELECT plate, a.primer AS i5_id, a.idx AS index2, b.primer AS i7_id, reverse(translate(b.idx, 'ACGT', 'TGCA')) AS "index" FROM p AS a JOIN p AS b USING (plate) WHERE a.primer_end = 'i5' AND b.primer_end = 'i7'""")
def sample_sheet_plates(t: Inputs) -> DataFrame:
    return m.sample_sheet(t.fx_plates, "GGCGACCACCGA", "ACACTCTTTCC", plate="plate")


def _reads(t: Inputs) -> DataFrame:
    return t.fx_reads.select("read_id", F.substring("r1_seq", 1, 12).alias("umi"), "r2_seq", F.col("r1_seq").contains(ANCHOR).alias("ont"))


_SAMPLED = """s AS (SELECT rep, umi FROM (SELECT rep, umi, row_number() OVER (PARTITION BY rep ORDER BY md5(concat('0:', CAST(rep AS STRING), ':', umi)), umi) AS k
  FROM (SELECT DISTINCT umi FROM r) AS u, range(1, {n}) AS g(rep)) AS x WHERE k <= 500),
  p AS (SELECT umi, avg(CAST(contains(r2_seq, '{a}') AS INT)) AS start, avg(CAST(contains(r2_seq, '{b}') AS INT)) AS "end", count(*) AS reads FROM r GROUP BY 1)"""
_READS = f"SELECT read_id, substr(r1_seq, 1, 12) AS umi, r2_seq FROM fx_reads"


@query("double_anchor", f"""WITH r AS ({_READS} WHERE contains(r1_seq, '{ANCHOR}')), {_SAMPLED.format(n=4, a=START, b=END)}
  SELECT CAST(rep AS INT) AS rep, count(*) AS umis, round(avg(CAST(start > 0 AND "end" > 0 AS INT)), 9) AS "both" FROM s JOIN p USING (umi) GROUP BY 1""")
def double_anchor(t: Inputs) -> DataFrame:
    return q.double_anchor(_reads(t), START, END, 500).withColumn("both", F.round("both", 9))


@query("anchor_stats", f"""WITH r AS ({_READS}), {_SAMPLED.format(n=3, a=START, b=END)}
  SELECT umi, CAST(rep AS INT) AS rep, round(start, 9) AS start, round("end", 9) AS "end", reads FROM s JOIN p USING (umi)""")
def anchor_stats(t: Inputs) -> DataFrame:
    return q.anchor_stats(_reads(t), START, END, 500, 2).withColumns({c: F.round(c, 9) for c in ("start", "end")})


@query("saturation_curve", f"""WITH r AS ({_READS}), n AS (SELECT count(*) AS total FROM r),
  p AS (SELECT rep, umi, CAST(concat('0x', substr(md5(concat('0:', CAST(rep AS STRING), ':', read_id, ':', umi)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) * total AS place FROM r, n, range(1, 4) AS g(rep)),
  x AS (SELECT rep, size, umi, count(*) AS n FROM p JOIN (VALUES (500), (1000), (2000), (4000), (8000), (16000)) AS v(size) ON size > place GROUP BY 1, 2, 3),
  o AS (SELECT rep, size, count(*) AS umis, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS least, max(n) AS most FROM x GROUP BY 1, 2),
  c AS (SELECT size, avg(umis) AS umis, avg(mean) AS mean, avg(median) AS median, avg(least) AS least, avg(most) AS most FROM o GROUP BY 1),
  v AS (SELECT *, (umis - lag(umis) OVER (ORDER BY size)) / (size - lag(size) OVER (ORDER BY size)) AS velocity FROM c)
  SELECT size, round(umis, 6) AS umis, round(mean, 6) AS mean, round(median, 6) AS median, round(least, 6) AS least, round(most, 6) AS most, round(velocity, 6) AS velocity,
    round(avg(velocity) OVER (ORDER BY size ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smooth FROM v""")
def saturation_curve(t: Inputs) -> DataFrame:
    out = q.saturation_curve(_reads(t), [500, 1000, 2000, 4000, 8000, 16000])
    return out.select("size", *(F.round(c, 6).alias(c) for c in out.columns if c != "size"))


_HIST = "(SELECT reads, count(*) AS umis FROM (SELECT cbc, count(*) AS reads FROM fx_mols GROUP BY 1) AS c GROUP BY 1) AS h"


@query("reads_per_umi_ecdf", f"SELECT reads, umis, round(sum(umis) OVER (ORDER BY reads DESC) / sum(umis) OVER (), 9) AS at_least FROM {_HIST}")
def reads_per_umi_ecdf(t: Inputs) -> DataFrame:
    return q.reads_per_umi_ecdf(t.fx_mols.select(F.col("cbc").alias("umi"))).withColumn("at_least", F.round("at_least", 9))


@query("knee_threshold", f"""WITH c AS (SELECT reads, log10(reads) AS y, log10(sum(umis) OVER (ORDER BY reads DESC)) AS x FROM {_HIST}),
  e AS (SELECT min(x) AS x0, arg_min(y, x) AS y0, max(x) AS x1, arg_max(y, x) AS y1 FROM c)
  SELECT reads AS threshold FROM c, e ORDER BY round(abs((y1 - y0) * x - (x1 - x0) * y + x1 * y0 - y1 * x0), 9) DESC, reads DESC LIMIT 1""")
def knee_threshold(t: Inputs) -> DataFrame:
    return q.knee_threshold(t.fx_mols.select(F.col("cbc").alias("umi")))


@query("bin_values", "SELECT umi, CASE WHEN umi_reads <= 5 THEN 'low' WHEN umi_reads <= 20 THEN 'mid' ELSE 'high' END AS bin FROM fx_mols")
def bin_values(t: Inputs) -> DataFrame:
    return t.fx_mols.select("umi", q.bin_values(F.col("umi_reads"), [5, 20], ["low", "mid", "high"]).alias("bin"))


@query("valid_ont_crosstab", f"""SELECT concat('s', right(read_id, 1)) AS sample_id, length(regexp_extract(r1_seq, '(.*?){ANCHOR}$', 1)) = 18 AS valid_umi, contains(r1_seq, '{ANCHOR}') AS ont, count(*) AS reads FROM fx_reads GROUP BY 1, 2, 3""")
def valid_ont_crosstab(t: Inputs) -> DataFrame:
    p = r.parse_barcodes(t.fx_reads, 12, ANCHOR, 6).withColumn("sample_id", F.concat(F.lit("s"), F.right("read_id", F.lit(1))))
    return q.valid_ont_crosstab(p)


NAMES = ["parquet_total_reads", "parquet_total_umis", "preprocess_n_valid", "preprocess_n_invalid"]
_WIDE = """(SELECT sample_id, CAST(count(*) AS DOUBLE) AS parquet_total_reads, CAST(count(DISTINCT umi) AS DOUBLE) AS parquet_total_umis, CAST(count(*) FILTER (WHERE wt) AS DOUBLE) AS preprocess_n_valid,
  CAST(count(*) FILTER (WHERE NOT wt) AS DOUBLE) AS preprocess_n_invalid FROM fx_mols GROUP BY 1) AS wide"""


def _wide(t: Inputs) -> DataFrame:
    ok = F.col("wt").cast("int")
    return t.fx_mols.groupBy("sample_id").agg(*(c.cast("double").alias(n) for n, c in zip(NAMES, (F.count("*"), F.countDistinct("umi"), F.sum(ok), F.sum(1 - ok)), strict=True)))


@query("metrics_long_wide", f"SELECT * FROM {_WIDE}")
def metrics_long_wide(t: Inputs) -> DataFrame:
    return q.metrics_wide(q.metrics_long(_wide(t), NAMES), NAMES)


@query("coverage_and_validity", f"""SELECT sample_id, round(parquet_total_reads / parquet_total_umis, 9) AS reads_per_umi, round(100 * preprocess_n_valid / (preprocess_n_valid + preprocess_n_invalid), 9) AS valid_pct FROM {_WIDE} ORDER BY 3 DESC, 1""")
def coverage_and_validity(t: Inputs) -> DataFrame:
    return q.coverage_and_validity(_wide(t)).withColumns({c: F.round(c, 9) for c in ("reads_per_umi", "valid_pct")})


_SAMPLES = ["S0", "S1", "S2", "S3"]
_MC = ", ".join(f"count(*) FILTER (WHERE sample = '{s}') AS \"cells_{s}\", round(avg(CAST(sample = '{s}' AS INT)), 9) AS \"share_{s}\", round(coalesce(log10(sum(CASE WHEN sample = '{s}' THEN umis END)), 0), 9) AS \"log_umis_{s}\"" for s in _SAMPLES)


@query("metacell_metadata", f"""SELECT metacell, count(*) AS size, round(avg(umis), 9) AS mean_umis, quantile_cont(umis, 0.5) AS median_umis, {_MC} FROM (SELECT raw_ibar AS metacell, sample_id AS sample, cbc, count(*) AS umis FROM fx_mols GROUP BY 1, 2, 3) AS c GROUP BY 1""")
def metacell_metadata(t: Inputs) -> DataFrame:
    cells = t.fx_mols.groupBy(F.col("raw_ibar").alias("metacell"), F.col("sample_id").alias("sample"), "cbc").agg(F.count("*").alias("umis"))
    out = q.metacell_metadata(cells, _SAMPLES)
    return out.select(*(F.round(c, 9).alias(c) if c.startswith(("mean", "share", "log")) else F.col(c) for c in out.columns))


@query("cell_gene_filter", """SELECT cell, CAST(sum(umis) AS BIGINT) AS umis, round(sum(CASE WHEN regexp_matches(gene, '^A') THEN umis ELSE 0 END) / sum(umis), 9) AS excluded_share FROM (SELECT cbc AS cell, raw_ibar AS gene, CAST(umi_reads AS BIGINT) AS umis FROM fx_mols) AS g
  GROUP BY 1 HAVING sum(umis) BETWEEN 500 AND 20000 AND sum(CASE WHEN regexp_matches(gene, '^A') THEN umis ELSE 0 END) / sum(umis) <= 0.25""")
def cell_gene_filter(t: Inputs) -> DataFrame:
    g = t.fx_mols.select(F.col("cbc").alias("cell"), F.col("raw_ibar").alias("gene"), F.col("umi_reads").cast("long").alias("umis"))
    return q.cell_gene_filter(g, "^A", max_share=0.25).withColumn("excluded_share", F.round("excluded_share", 9))


@query("module_similarity", """WITH s AS (SELECT raw_ibar AS gene1, spacer AS gene2, avg(umi_reads) AS similarity FROM fx_mols GROUP BY 1, 2)
  SELECT substr(gene1, 1, 1) AS module1, substr(gene2, 1, 1) AS module2, round(avg(similarity), 9) AS similarity FROM s GROUP BY 1, 2""")
def module_similarity(t: Inputs) -> DataFrame:
    s = t.fx_mols.groupBy(F.col("raw_ibar").alias("gene1"), F.col("spacer").alias("gene2")).agg(F.avg("umi_reads").alias("similarity"))
    genes = t.fx_mols.select(F.explode(F.array("raw_ibar", "spacer")).alias("gene")).distinct().withColumn("module", F.substring("gene", 1, 1))
    return q.module_similarity(s, genes).withColumn("similarity", F.round("similarity", 9))


@query("parsimony_score")
def parsimony_score(t: Inputs) -> DataFrame:
    return tr.parsimony_score(t.fx_tree_edges, t.fx_tree_alleles)


@query("parsimony_null")
def parsimony_null(t: Inputs) -> DataFrame:
    return tr.parsimony_null(t.fx_tree_edges, t.fx_tree_alleles)


@query("tree_qc_summary")
def tree_qc_summary(t: Inputs) -> DataFrame:
    return tr.tree_qc_summary(tr.parsimony_null(t.fx_tree_edges, t.fx_tree_alleles), t.fx_tree_alleles)
