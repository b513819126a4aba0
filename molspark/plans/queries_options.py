"""Queries of the operators' further options: bounds, spans, depths, methods and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import multisite as m
from ..operators import qc as q
from ..operators import reads as r
from ..operators import umi as u
from .registry import Inputs, query

_ADAPTER = "ATCGTGCGGACG"


@query("quality_background_first", """SELECT CAST(i - 1 AS INT) AS pos, quantile_cont(ascii(substr(quality_scores, CAST(i AS BIGINT), 1)) - 33, 0.25) AS q
  FROM (SELECT quality_scores, unnest(range(1, length(quality_scores) + 1)) AS i FROM (SELECT * FROM fx_long ORDER BY name LIMIT 300) AS f) AS e GROUP BY 1""")
def quality_background_first(t: Inputs) -> DataFrame:
    """The first 300 reads: the bound is the option."""
    return r.quality_background_quantile(t.fx_long, "quality_scores", 0.25, first=300, order="name")


@query("regex_trim_end", f"""WITH p AS (SELECT read_id, r2_seq, CASE WHEN regexp_matches(r2_seq, '{_ADAPTER}') THEN length(regexp_extract(r2_seq, '^(.*?){_ADAPTER}', 1)) + {len(_ADAPTER)} END AS place FROM fx_reads)
  SELECT read_id, substr(r2_seq, 1, coalesce(place, (SELECT CAST(floor(avg(place)) AS BIGINT) FROM p), length(r2_seq))) AS trimmed FROM p""")
def regex_trim_end(t: Inputs) -> DataFrame:
    return r.regex_trim(t.fx_reads, _ADAPTER, "r2_seq", span_index=1).select("read_id", "trimmed")


@query("keep_groups", """SELECT read_id, CASE WHEN regexp_matches(r2_seq, 'CATCTTAG(.{4}).*?(GACAGG.{2})') THEN concat(regexp_extract(r2_seq, 'CATCTTAG(.{4}).*?(GACAGG.{2})', 1), regexp_extract(r2_seq, 'CATCTTAG(.{4}).*?(GACAGG.{2})', 2)) ELSE r2_seq END AS trimmed FROM fx_reads""")
def keep_groups(t: Inputs) -> DataFrame:
    return r.keep_groups(t.fx_reads, "CATCTTAG(?P<left>.{4}).*?(?P<right>GACAGG.{2})", "r2_seq").select("read_id", "trimmed")


@query("correction_report", """WITH p AS (SELECT DISTINCT cbc AS raw, concat(substr(cbc, 1, 15), 'A') AS corrected FROM fx_mols WHERE doublet_prediction = 'singlet' AND cluster = 1),
  c AS (SELECT coalesce(corrected, cbc) AS cbc, corrected IS NOT NULL AS matched FROM fx_mols LEFT JOIN p ON cbc = raw)
  SELECT 'matched' AS "case", NULL AS cbc, CAST(sum(CAST(matched AS INT)) AS BIGINT) AS reads, round(avg(CAST(matched AS INT)), 9) AS fraction FROM c
  UNION ALL SELECT 'missed', cbc, count(*), round(count(*) / (SELECT count(*) FROM c), 9) FROM c WHERE NOT matched GROUP BY cbc""")
def correction_report(t: Inputs) -> DataFrame:
    tagged = t.fx_mols.where("doublet_prediction = 'singlet' and cluster = 1").select("cbc", F.expr("concat(substr(cbc, 1, 15), 'A-1')").alias("CB"))
    out = r.correction_report(r.correct_barcodes(t.fx_mols.select("umi", "cbc"), r.correction_pairs(tagged, "cbc", "CB")))
    return out.withColumn("fraction", F.round("fraction", 9))


@query("umi_collapse_mates", """WITH a AS (SELECT read_id, substr(r1_seq, 1, 12) AS umi FROM fx_reads WHERE right(read_id, 1) IN ('1', '2', '3')),
  k AS (SELECT umi, r2_seq FROM fx_reads JOIN a USING (read_id) WHERE regexp_matches(r2_seq, 'CATCTTAG') AND CAST(concat('0x', substr(md5(concat('5:', read_id)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CAST(0.7 AS DOUBLE))
  SELECT umi, count(*) AS reads, count(DISTINCT r2_seq) AS seqs FROM k GROUP BY umi HAVING count(*) >= 2""")
def umi_collapse_mates(t: Inputs) -> DataFrame:
    """UMIs of read 1 go to read 2 by read id; reads that match a pattern, a share of them drawn by hash."""
    mates = t.fx_reads.where("right(read_id, 1) in ('1', '2', '3')").select("read_id", F.substring("r1_seq", 1, 12).alias("umi"))
    keyed = u.umi_from_mates(t.fx_reads.select("read_id", "r2_seq"), mates)
    return u.umi_collapse(keyed, F.col("umi"), min_reads=2, seq="r2_seq", match_pattern="CATCTTAG", fraction=0.7, seed=5)


@query("umi_collapse_tags", """WITH t AS (SELECT coalesce(CASE WHEN wt THEN cbc || umi END, CASE WHEN cluster <> 2 THEN raw_ibar || umi END) AS k, seq FROM fx_mols)
  SELECT k AS umi, count(*) AS reads, count(DISTINCT seq) AS seqs FROM t WHERE k IS NOT NULL GROUP BY 1""")
def umi_collapse_tags(t: Inputs) -> DataFrame:
    """Corrected tags, raw ones where a corrected one is missing, reads without either left out."""
    tagged = t.fx_mols.selectExpr("case when wt then cbc end as CB", "umi as UB", "case when cluster <> 2 then raw_ibar end as CR", "umi as UR", "seq")
    return u.umi_collapse(tagged, u.umi_from_tags(use_uncorrected=True))


@query("umi_collapse_pairs", """WITH a AS (SELECT substr(r1_seq, 1, 12) AS umi, count(*) AS n, count(DISTINCT r1_seq) AS s FROM fx_reads WHERE right(read_id, 1) <> '1' GROUP BY 1),
  b AS (SELECT substr(r1_seq, 1, 12) AS umi, count(*) AS n, count(DISTINCT r2_seq) AS s FROM fx_reads WHERE right(read_id, 1) <> '2' GROUP BY 1)
  SELECT umi, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS reads, coalesce(a.s, 0) AS seqs_r1, coalesce(b.s, 0) AS seqs_r2 FROM a FULL JOIN b USING (umi) WHERE greatest(coalesce(a.n, 0), coalesce(b.n, 0)) >= 2""")
def umi_collapse_pairs(t: Inputs) -> DataFrame:
    umi = F.substring("r1_seq", 1, 12).alias("umi")
    r1 = t.fx_reads.where("right(read_id, 1) <> '1'").select(umi, F.col("r1_seq").alias("seq"))
    r2 = t.fx_reads.where("right(read_id, 1) <> '2'").select(umi, F.col("r2_seq").alias("seq"))
    return u.umi_collapse_pairs(r1, r2, 2)


@query("split_by_coverage", """WITH n AS (SELECT raw_ibar AS intid1, substr(seq, 1, 6) AS intid2, count(*) AS reads FROM fx_mols GROUP BY 1, 2) SELECT * FROM n WHERE reads >= CAST(0.5 AS DOUBLE) * (SELECT max(reads) FROM n)""")
def split_by_coverage(t: Inputs) -> DataFrame:
    return m.split_by_coverage(t.fx_mols.select(F.col("raw_ibar").alias("intid1"), F.substring("seq", 1, 6).alias("intid2")), 0.5)


@query("reads_per_umi_depths", """WITH r AS (SELECT substr(r1_seq, 1, 12) AS umi, 1 + CAST(floor(CAST(concat('0x', substr(md5(concat('0:', read_id)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) * 5) AS INT) AS place FROM fx_reads),
  h AS (SELECT depth, reads, count(*) AS umis FROM (SELECT depth, umi, count(*) AS reads FROM r, range(1, 6) AS g(depth) WHERE depth >= place GROUP BY 1, 2) AS c GROUP BY 1, 2)
  SELECT CAST(depth AS INT) AS depth, reads, umis, round(sum(umis) OVER (PARTITION BY depth ORDER BY reads DESC) / sum(umis) OVER (PARTITION BY depth), 9) AS at_least FROM h""")
def reads_per_umi_depths(t: Inputs) -> DataFrame:
    reads = t.fx_reads.select("read_id", F.substring("r1_seq", 1, 12).alias("umi"))
    return q.reads_per_umi_depths(reads).withColumn("at_least", F.round("at_least", 9))


@query("knee_threshold_drop", """WITH h AS (SELECT DISTINCT reads FROM (SELECT cbc, count(*) AS reads FROM fx_mols GROUP BY 1) AS c), d AS (SELECT reads, log10(reads) - lag(log10(reads)) OVER (ORDER BY reads DESC) AS fall FROM h)
  SELECT reads AS threshold FROM d WHERE fall IS NOT NULL ORDER BY round(fall, 9), reads DESC LIMIT 1""")
def knee_threshold_drop(t: Inputs) -> DataFrame:
    return q.knee_threshold(t.fx_mols.select(F.col("cbc").alias("umi")), method="drop")


@query("knee_threshold_kmeans")
def knee_threshold_kmeans(t: Inputs) -> DataFrame:
    return q.knee_threshold(t.fx_mols.select(F.col("cbc").alias("umi")), method="kmeans").withColumn("threshold", F.round("threshold", 6))
