"""Queries of the UMI, k-mer and assembly operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kmers as k
from ..operators import umi as u
from .constants import END, METAS, START
from .registry import Inputs, query

_R = "(SELECT substr(r1_seq, 1, 12) AS umi, substr(r1_seq, 13, 6) AS sbc, r2_seq AS seq, read_id FROM fx_reads) AS r"


def reads(t: Inputs) -> DataFrame:
    return t.fx_reads.select(F.substring("r1_seq", 1, 12).alias("umi"), F.substring("r1_seq", 13, 6).alias("sbc"), F.col("r2_seq").alias("seq"), "read_id")


@query("umi_collapse", f"SELECT umi, count(*) AS reads, count(DISTINCT seq) AS seqs FROM {_R} GROUP BY umi HAVING count(*) >= 2")
def umi_collapse(t: Inputs) -> DataFrame:
    return u.umi_collapse(reads(t), F.col("umi"), min_reads=2).withColumn("reads", F.col("reads").cast("long"))


@query("umi_counts", f"SELECT umi, count(*) AS reads FROM {_R} GROUP BY umi HAVING count(*) >= 2 ORDER BY 2 DESC, 1 DESC")
def umi_counts(t: Inputs) -> DataFrame:
    return u.umi_counts(reads(t), 2)


_SAT = ", ".join(f"CAST(count(*) FILTER (WHERE reads >= {n}) AS BIGINT) AS umis_{n}" for n in (1, 2, 3, 4, 5, 10, 100, 1000))


@query("umi_saturation", f"SELECT {_SAT} FROM (SELECT umi, count(*) AS reads FROM {_R} GROUP BY umi) AS c")
def umi_saturation(t: Inputs) -> DataFrame:
    return u.umi_saturation(u.umi_counts(reads(t)))


_HAM = "CAST((SELECT count(*) FROM range(1, 7) AS g(i) WHERE substr({a}, i, 1) <> substr({b}, i, 1)) AS INT)"


@query("hamming_matrix", f"""WITH n AS (SELECT raw_ibar AS b, count(*) AS n FROM fx_mols GROUP BY 1)
  SELECT * FROM (SELECT x.b AS a, y.b AS b, x.n AS n_a, y.n AS n_b, {_HAM.format(a='x.b', b='y.b')} AS distance FROM n AS x CROSS JOIN n AS y) AS m WHERE a = b OR distance > 0""")
def hamming_matrix(t: Inputs) -> DataFrame:
    return u.hamming_matrix(t.fx_mols, "raw_ibar")


_MERGE = f"""c AS (SELECT raw_ibar AS bc, count(*) AS n FROM fx_mols GROUP BY 1),
  p AS (SELECT x.bc AS old, y.bc AS new, row_number() OVER (PARTITION BY x.bc ORDER BY y.n DESC, y.bc DESC) AS k FROM c AS x JOIN c AS y
    ON (y.n > x.n OR y.n = x.n AND y.bc > x.bc) AND {_HAM.format(a='x.bc', b='y.bc')} <= 3),
  m AS (SELECT bc AS old, coalesce(new, bc) AS new FROM c LEFT JOIN (SELECT old, new FROM p WHERE k = 1) AS b ON bc = old)"""


def ibar_counts(t: Inputs) -> DataFrame:
    return t.fx_mols.groupBy(F.col("raw_ibar").alias("umi")).agg(F.count("*").alias("reads"))


@query("barcode_merge", f"WITH {_MERGE} SELECT old, new FROM m")
def barcode_merge(t: Inputs) -> DataFrame:
    return u.barcode_merge(ibar_counts(t), 3)


@query("umi_correct", f"""WITH RECURSIVE {_MERGE}, up AS (SELECT old, new, 0 AS d FROM m UNION ALL SELECT up.old, m.new, d + 1 FROM up JOIN m ON up.new = m.old WHERE m.new <> m.old),
  root AS (SELECT old, arg_max(new, d) AS new FROM up GROUP BY old) SELECT umi AS molecule, new AS umi FROM fx_mols JOIN root ON raw_ibar = old""")
def umi_correct(t: Inputs) -> DataFrame:
    return u.umi_correct(t.fx_mols.select(F.col("umi").alias("molecule"), F.col("raw_ibar").alias("umi")), 3)


_DOM = f"""(SELECT umi, seq AS dominant_seq, n AS dominant_reads, reads_per_umi, pool_size FROM (SELECT umi, seq, n, CAST(sum(n) OVER (PARTITION BY umi) AS BIGINT) AS reads_per_umi,
  count(*) OVER (PARTITION BY umi) AS pool_size, row_number() OVER (PARTITION BY umi ORDER BY n DESC, seq) AS k FROM (SELECT umi, seq, count(*) AS n FROM {_R} GROUP BY 1, 2) AS c) AS d WHERE k = 1) AS dom"""


@query("umi_dominant_seq", f"SELECT * FROM {_DOM}")
def umi_dominant_seq(t: Inputs) -> DataFrame:
    return u.umi_dominant_seq(reads(t))


@query("umi_coverage_table", f"""SELECT cell, umi, reads_per_umi AS reads, pool_size AS seqs, dominant_reads AS rank1_reads FROM (SELECT DISTINCT substr(umi, 1, 3) AS cell, umi FROM {_R}) AS c JOIN {_DOM} USING (umi)""")
def umi_coverage_table(t: Inputs) -> DataFrame:
    r = reads(t)
    return u.umi_coverage_table(r, r.select(F.substring("umi", 1, 3).alias("cell"), "umi").distinct())


@query("cell_dominant_allele", """SELECT cell, seq AS allele, pool AS seqs, round(n / total, 9) AS share FROM (SELECT cell, seq, n, sum(n) OVER (PARTITION BY cell) AS total,
  count(*) OVER (PARTITION BY cell) AS pool, row_number() OVER (PARTITION BY cell ORDER BY n DESC, seq) AS k
  FROM (SELECT raw_ibar AS cell, seq, count(*) AS n FROM fx_mols GROUP BY 1, 2) AS c) AS d WHERE k = 1 AND pool >= 3 AND n / total >= 0.3""")
def cell_dominant_allele(t: Inputs) -> DataFrame:
    out = u.cell_dominant_allele(t.fx_mols.select(F.col("raw_ibar").alias("cell"), "seq"), 3, 0.3)
    return out.withColumn("share", F.round("share", 9))


@query("merged_unmerged_reconcile", """SELECT DISTINCT umi FROM fx_mols WHERE umi_reads > 10 AND umi IN (SELECT umi FROM fx_mols WHERE cluster <> 2) AND umi NOT IN (SELECT umi FROM fx_mols WHERE wt)""")
def merged_unmerged_reconcile(t: Inputs) -> DataFrame:
    return u.merged_unmerged_reconcile(t.fx_mols.where("wt"), t.fx_mols.where("umi_reads > 10"), t.fx_mols.where("cluster <> 2"))


_CONS = """WITH e AS (SELECT raw_ibar, CAST(i AS INT) AS pos, lower(substr(spacer_seq, CAST(i AS BIGINT), 1)) AS b FROM (SELECT raw_ibar, seq AS spacer_seq, unnest(range(1, 21)) AS i FROM fx_mols) AS x),
  n AS (SELECT raw_ibar, pos, b, count(*) AS n FROM e GROUP BY 1, 2, 3),
  w AS (SELECT *, row_number() OVER (PARTITION BY raw_ibar, pos ORDER BY n DESC, strpos('acgt-n', b)) AS k FROM n)"""


@query("pileup_consensus", f"{_CONS} SELECT raw_ibar, string_agg(b, '' ORDER BY pos) AS consensus FROM w WHERE k = 1 GROUP BY 1")
def pileup_consensus(t: Inputs) -> DataFrame:
    return u.pileup_consensus(t.fx_mols, "raw_ibar")




@query("kmer_explode", """SELECT seq, kmer FROM (SELECT seq, kmer, count(*) OVER (PARTITION BY kmer) AS n FROM (SELECT seq, substr(seq, CAST(i AS BIGINT), 12) AS kmer FROM
  (SELECT seq, unnest(range(1, least(500, length(seq) - 11) + 1)) AS i FROM (SELECT DISTINCT seq FROM fx_mols) AS d) AS x) AS e) AS c WHERE n = 1""")
def kmer_explode(t: Inputs) -> DataFrame:
    return k.kmer_explode(t.fx_mols.select("seq").distinct(), "seq", 12).select("seq", "kmer")


@query("kmer_counts", """SELECT sample_id, kmer, count(*) AS reads FROM (SELECT DISTINCT sample_id, rid, substr(seq, CAST(i AS BIGINT), 8) AS kmer FROM
  (SELECT sample_id, rid, seq, unnest(range(1, length(seq) - 6)) AS i FROM (SELECT sample_id, seq, row_number() OVER () AS rid FROM fx_mols) AS z) AS x) AS e GROUP BY 1, 2""")
def kmer_counts(t: Inputs) -> DataFrame:
    return k.kmer_counts(t.fx_mols, "sample_id", "seq", 8)


@query("debruijn_edges", """SELECT sample_id, substr(kmer, 1, 7) AS src, substr(kmer, 2, 7) AS dst, count(*) AS count FROM
  (SELECT sample_id, substr(seq, CAST(i AS BIGINT), 8) AS kmer FROM (SELECT sample_id, seq, unnest(range(1, 14)) AS i FROM fx_mols) AS x) AS e GROUP BY sample_id, kmer""")
def debruijn_edges(t: Inputs) -> DataFrame:
    return k.debruijn_edges(t.fx_mols.where("length(seq) = 20"), ["sample_id"], "seq", 8)


def contigs(t: Inputs) -> DataFrame:
    return k.assemble_umis(reads(t), ["umi", "sbc"], seq="seq", k=15, min_coverage=2, start_anchor=START, end_anchor=END)


@query("assemble_umis")
def assemble_umis(t: Inputs) -> DataFrame:
    return contigs(t)


@query("assembly_sweep")
def assembly_sweep(t: Inputs) -> DataFrame:
    return k.assembly_sweep(reads(t), ["umi"], [13, 17], [1, 2], seq="seq", start_anchor=START, end_anchor=END)


@query("assembly_optimize")
def assembly_optimize(t: Inputs) -> DataFrame:
    return k.assembly_optimize(reads(t), ["umi"], [13, 17], [1, 2], seq="seq", start_anchor=START, end_anchor=END)


@query("contig_table")
def contig_table(t: Inputs) -> DataFrame:
    return k.contig_table(reads(t), ["umi", "sbc"], 3, "s1", seq="seq", min_coverage=2, start_anchor=START, end_anchor=END)


@query("assembly_metrics", """SELECT round(avg(CAST(n > 0 AS INT)), 9) AS success_rate, count(CASE WHEN n > 0 THEN 1 END) AS total_assembled,
  round(avg(CASE WHEN n > 0 THEN n END), 9) AS mean_length, quantile_cont(CASE WHEN n > 0 THEN n END, 0.5) AS median_length
  FROM (SELECT CASE WHEN umi_reads > 10 THEN length(concat(seq, raw_ibar)) ELSE 0 END AS n FROM fx_mols) AS c""")
def assembly_metrics(t: Inputs) -> DataFrame:
    m = k.assembly_metrics(t.fx_mols.select(F.when(F.col("umi_reads") > 10, F.concat("seq", "raw_ibar")).otherwise("").alias("contig")))
    return m.withColumns({c: F.round(c, 9) for c in ("success_rate", "mean_length")})


_REFS = ", ".join(f"('mod_{n}', '{s}')" for n, s in METAS.items())


@query("kmer_classify", f"""WITH refs AS (SELECT * FROM (VALUES {_REFS}) AS v(mod, seq)),
  rk AS (SELECT kmer, min(mod) AS mod FROM (SELECT mod, substr(seq, CAST(i AS BIGINT), 12) AS kmer FROM (SELECT mod, seq, unnest(range(1, length(seq) - 10)) AS i FROM refs) AS x) AS e GROUP BY kmer HAVING count(*) = 1),
  ck AS (SELECT DISTINCT substr(seq, 13, 14) AS intBC, sbc, umi, substr(seq, CAST(i AS BIGINT), 12) AS kmer FROM (SELECT *, unnest(range(1, least(500, length(seq) - 11) + 1)) AS i FROM {_R}) AS x),
  f AS (SELECT intBC, mod, sum(n) AS fps FROM (SELECT intBC, mod, sbc, count(DISTINCT umi) AS n FROM ck JOIN rk USING (kmer) GROUP BY 1, 2, 3) AS g GROUP BY 1, 2)
  SELECT intBC, mod, CAST(fps AS BIGINT) AS fps FROM (SELECT *, row_number() OVER (PARTITION BY intBC ORDER BY fps DESC, mod) AS k FROM f) AS z WHERE k = 1""")
def kmer_classify(t: Inputs) -> DataFrame:
    c = reads(t).select(F.expr("substr(seq, 13, 14)").alias("intBC"), "sbc", "umi", F.col("seq").alias("contig"))
    refs = t.fx_features.where("kind = 'META'").select(F.concat(F.lit("mod_"), "feature").alias("mod"), "seq")
    return k.kmer_classify(c, refs, 12)
