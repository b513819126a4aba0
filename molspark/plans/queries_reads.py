"""Queries of the sequence functions and read operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as s
from ..operators import reads as r
from .constants import ANCHOR, END, METAS, START
from .registry import Inputs, query

UMI, SBC = 12, 6
_FUZZY = {k: s.fuzzy_pattern(v) for k, v in METAS.items()}


@query("reverse_complement", "SELECT read_id, reverse(translate(r2_seq, 'ACGTMKRYVBacgtvb', 'TGCAKMYRBVtgcabv')) AS rc FROM fx_reads")
def reverse_complement(t: Inputs) -> DataFrame:
    return t.fx_reads.select("read_id", s.reverse_complement("r2_seq").alias("rc"))


@query("fuzzy_pattern", "SELECT read_id, " + ", ".join(f"regexp_matches(r2_seq, '{p}') AS {k.lower()}" for k, p in _FUZZY.items()) + " FROM fx_reads")
def fuzzy_pattern(t: Inputs) -> DataFrame:
    return t.fx_reads.select("read_id", *(F.col("r2_seq").rlike(p).alias(k.lower()) for k, p in _FUZZY.items()))


def _nested(col: str) -> str:
    for text in [*METAS.values(), START, END]:
        col = f"regexp_replace({col}, '{s.fuzzy_pattern(text)}', '{text}', 'g')"
    return col


@query("fuzzy_sanitize", f"SELECT read_id, {_nested('r2_seq')} AS r2_seq FROM fx_reads")
def fuzzy_sanitize(t: Inputs) -> DataFrame:
    return r.fuzzy_sanitize(t.fx_reads.select("read_id", "r2_seq"), list(METAS.values()), [START, END], "r2_seq")


@query("approx_anchor_extract", f"""WITH c AS (SELECT read_id, r2_seq AS s, unnest(range(13, length(r2_seq) - 32)) AS p FROM fx_reads),
  d AS (SELECT read_id, s, p, levenshtein(substr(s, p - 12, 12), '{START}') AS a, levenshtein(substr(s, p + 14, 20), '{METAS["META01"]}') AS b FROM c),
  k AS (SELECT read_id, substr(s, p, 14) AS barcode, a + b AS edits, row_number() OVER (PARTITION BY read_id ORDER BY a + b, p) AS k FROM d WHERE a <= 2 AND b <= 2)
  SELECT read_id, r2_seq, barcode, CAST(edits AS INT) AS edits FROM fx_reads LEFT JOIN (SELECT * FROM k WHERE k = 1) AS b USING (read_id)""")
def approx_anchor_extract(t: Inputs) -> DataFrame:
    return r.approx_anchor_extract(t.fx_reads.select("read_id", "r2_seq"), "r2_seq", START, 2, 14, METAS["META01"], 2)


@query("spacer_correction", """SELECT seq, CASE WHEN regexp_matches(seq, '(G{1,2}T)(.*?)(GGGTTAGA)') THEN concat('GGT', regexp_extract(seq, '(G{1,2}T)(.*?)(GGGTTAGA)', 2),
  regexp_extract(seq, '(G{1,2}T)(.*?)(GGGTTAGA)', 3)) ELSE seq END AS fixed FROM fx_guides""")
def spacer_correction(t: Inputs) -> DataFrame:
    return t.fx_guides.select("seq", s.spacer_correction("seq").alias("fixed"))


@query("dna_scramble", """SELECT spacer, cbc, (SELECT string_agg(substr(spacer, i, 1), '' ORDER BY md5(concat(cbc, CAST(i AS STRING))), i) FROM range(1, 21) AS g(i)) AS scrambled
  FROM (SELECT DISTINCT spacer, cbc FROM fx_mols) AS m""")
def dna_scramble(t: Inputs) -> DataFrame:
    return t.fx_mols.select("spacer", "cbc").distinct().withColumn("scrambled", s.dna_scramble(F.col("cbc"), F.col("spacer")))


@query("quality_filter", "SELECT name FROM fx_long WHERE length(quality_scores) - length(regexp_replace(quality_scores, '[!-@]', '', 'g')) < 190")
def quality_filter(t: Inputs) -> DataFrame:
    return r.quality_filter(t.fx_long, "quality_scores", 190).select("name")


@query("quality_background_quantile", """SELECT CAST(i - 1 AS INT) AS pos, quantile_cont(ascii(substr(quality_scores, CAST(i AS BIGINT), 1)) - 33, 0.5) AS q
  FROM (SELECT quality_scores, unnest(range(1, length(quality_scores) + 1)) AS i FROM fx_long) AS e GROUP BY 1""")
def quality_background_quantile(t: Inputs) -> DataFrame:
    return r.quality_background_quantile(t.fx_long, "quality_scores")


_GUIDE = "ATGGG([ACGT]{18,20})GGGTTAGAGCTAGA([ACGT]{6})AATAGCAA"


@query("quality_span_gate", f"""WITH g AS (SELECT row_number() OVER () AS rid, seq, substr(repeat(md5(seq), 5), 1, length(seq)) AS qual FROM fx_guides),
  e AS (SELECT rid, CAST(i AS BIGINT) AS p, ascii(substr(qual, CAST(i AS BIGINT), 1)) - 33 AS v FROM (SELECT rid, qual, unnest(range(1, length(qual) + 1)) AS i FROM g) AS x),
  bg AS (SELECT p, quantile_cont(v, 0.5) AS q FROM e GROUP BY 1),
  h AS (SELECT rid, seq, regexp_extract(seq, '{_GUIDE}', 1) AS spacer, regexp_extract(seq, '{_GUIDE}', 2) AS ibar FROM g WHERE NOT contains(seq, 'N') AND regexp_matches(seq, '{_GUIDE}')),
  w AS (SELECT *, strpos(seq, spacer) AS s_at FROM h), z AS (SELECT *, s_at + length(spacer) - 1 + strpos(substr(seq, s_at + length(spacer)), ibar) AS i_at FROM w),
  f AS (SELECT rid, ibar, spacer, avg(CASE WHEN p BETWEEN s_at AND s_at + length(spacer) - 1 THEN CAST(v >= q AS INT) END) AS fs, avg(CASE WHEN p BETWEEN i_at AND i_at + length(ibar) - 1 THEN CAST(v >= q AS INT) END) AS fi
    FROM z JOIN e USING (rid) JOIN bg USING (p) GROUP BY 1, 2, 3),
  c AS (SELECT ibar, spacer, count(*) AS n FROM f WHERE fs >= 0.005 AND fi >= 0.009 GROUP BY 1, 2)
  SELECT * FROM c WHERE n >= (1 - CAST(0.95 AS DOUBLE)) * (SELECT max(n) FROM c)""")
def quality_span_gate(t: Inputs) -> DataFrame:
    guides = t.fx_guides.select("seq", F.expr("substr(repeat(md5(seq), 5), 1, length(seq))").alias("qual"))
    return r.quality_span_gate(guides, r.quality_background_quantile(guides, "qual"), _GUIDE)


@query("regex_trim", """WITH p AS (SELECT read_id, r2_seq, CASE WHEN regexp_matches(r2_seq, 'ATCGTGCGGACG') THEN length(regexp_extract(r2_seq, '^(.*?)ATCGTGCGGACG', 1)) END AS place FROM fx_reads)
  SELECT read_id, substr(r2_seq, 1, coalesce(place, (SELECT CAST(floor(avg(place)) AS BIGINT) FROM p), length(r2_seq))) AS trimmed FROM p""")
def regex_trim(t: Inputs) -> DataFrame:
    return r.regex_trim(t.fx_reads, "ATCGTGCGGACG", "r2_seq").select("read_id", "trimmed")


_ORIENT = s.fuzzy_pattern(ANCHOR, ".{0,4}")
_RC = "reverse(translate(sequence, 'ACGT', 'TGCA'))"
_ORIENTED = f"""(SELECT name, CASE WHEN flip THEN {_RC} ELSE sequence END AS oriented_sequence,
  CASE WHEN flip THEN reverse(quality_scores) ELSE quality_scores END AS oriented_quality
  FROM (SELECT *, NOT regexp_matches(sequence, '{_ORIENT}') AND regexp_matches({_RC}, '{_ORIENT}') AS flip FROM fx_long) AS f) AS o"""


@query("orient_reads", f"SELECT * FROM {_ORIENTED}")
def orient_reads(t: Inputs) -> DataFrame:
    return r.orient_reads(t.fx_long, ANCHOR).select("name", "oriented_sequence", "oriented_quality")


@query("ont_to_paired", f"""SELECT name AS read_id, substr(ts, 1, 31) AS r1_seq, substr(tq, 1, 31) AS r1_qual, substr(ts, 32) AS r2_seq, substr(tq, 32) AS r2_qual, CAST(trim_pos AS INT) AS trim_pos
  FROM (SELECT name, coalesce(after, oriented_sequence) AS ts, CASE WHEN after IS NULL THEN oriented_quality ELSE substr(oriented_quality, length(oriented_sequence) - length(after) + 1) END AS tq,
    length(oriented_sequence) - length(after) AS trim_pos
  FROM (SELECT *, CASE WHEN regexp_matches(oriented_sequence, '^(.*)({s.fuzzy_pattern(START, '.{0,4}')})(.*)$') THEN
    regexp_extract(oriented_sequence, '^(.*)({s.fuzzy_pattern(START, '.{0,4}')})(.*)$', 3) END AS after FROM {_ORIENTED.replace(_ORIENT, s.fuzzy_pattern(START, '.{0,4}'))}) AS a) AS b""")
def ont_to_paired(t: Inputs) -> DataFrame:
    return r.ont_to_paired(t.fx_long, UMI, SBC, START, ANCHOR)


def _parsed(anchor: str, tail: str = "") -> str:
    return f"""(SELECT *, count(*) OVER (PARTITION BY umi) AS reads FROM (SELECT *, substr(r1_seq, 1, 12) AS umi, substr(r1_seq, 13, 6) AS sbc, contains(r1_seq, '{anchor}') AS ont,
  length(regexp_extract(r1_seq, '(.*?){anchor}{tail}$', 1)) = 18 AS valid_umi FROM fx_reads) AS p) AS q"""


_METRICS = """round(avg(CAST(ont AS INT)) OVER (), 9) AS metric_fraction_ont, round(avg(1 - CAST(ont AS INT)) OVER (), 9) AS metric_fraction_offt,
  CAST(sum(CAST(ont AS INT)) OVER () AS BIGINT) AS metric_reads_ont, CAST(sum(1 - CAST(ont AS INT)) OVER () AS BIGINT) AS metric_reads_offt"""
_PARSED_COLS = ["read_id", "umi", "sbc", "ont", "valid_umi", "reads", "metric_reads_ont", "metric_reads_offt"]


def _read_view(df: DataFrame) -> DataFrame:
    return df.select(*_PARSED_COLS, *(F.round(c, 9).alias(c) for c in ("metric_fraction_ont", "metric_fraction_offt")))


@query("parse_reads", f"SELECT read_id, umi, sbc, ont, valid_umi, reads, {_METRICS} FROM {_parsed(ANCHOR)}")
def parse_reads(t: Inputs) -> DataFrame:
    return _read_view(r.parse_reads(t.fx_reads, UMI, ANCHOR, SBC))


@query("parse_reads_open_end", f"SELECT read_id, umi, sbc, ont, valid_umi, reads, {_METRICS} FROM {_parsed(ANCHOR[:6], '.*')}")
def parse_reads_open_end(t: Inputs) -> DataFrame:
    return _read_view(r.parse_reads(t.fx_reads, UMI, ANCHOR[:6], SBC, open_end=True))


@query("parse_read1", """SELECT read_id, r1_seq, r2_seq FROM fx_reads UNION ALL SELECT read_id, r1_seq, r2_seq FROM
  (SELECT read_id, r1_seq, regexp_extract(r1_seq, '.*?GGCACAC(.*)$', 1) AS r2_seq FROM fx_reads WHERE contains(r1_seq, 'GGCACAC')) AS x WHERE r2_seq <> ''""")
def parse_read1(t: Inputs) -> DataFrame:
    return r.parse_read1(t.fx_reads.select("read_id", "r1_seq", "r2_seq"), "GGCACAC")


@query("preprocess_split", f"SELECT read_id, 's1' AS sample_id, valid_umi AND ont AS is_valid FROM {_parsed(ANCHOR)}")
def preprocess_split(t: Inputs) -> DataFrame:
    valid, invalid = r.preprocess_split(r.parse_reads(t.fx_reads, UMI, ANCHOR, SBC), "s1")
    return valid.select("read_id", "sample_id", F.lit(True).alias("is_valid")).unionByName(invalid.select("read_id", "sample_id", F.lit(False).alias("is_valid")))


@query("preprocess_metrics", f"""SELECT round(avg(CAST(valid_umi AS INT)), 9) AS fraction_valid_umis, CAST(sum(CAST(valid_umi AS INT)) AS BIGINT) AS n_valid_umis,
  CAST(sum(1 - CAST(valid_umi AS INT)) AS BIGINT) AS n_invalid_umis, (SELECT count(*) FROM fx_reads WHERE contains(r1_seq, '{ANCHOR}')) AS metric_reads_ont
  FROM (SELECT DISTINCT umi, valid_umi FROM {_parsed(ANCHOR)}) AS d""")
def preprocess_metrics(t: Inputs) -> DataFrame:
    m = r.preprocess_metrics(r.parse_reads(t.fx_reads, UMI, ANCHOR, SBC))
    return m.select(F.round("fraction_valid_umis", 9).alias("fraction_valid_umis"), "n_valid_umis", "n_invalid_umis", "metric_reads_ont")


@query("read_umi_totals", "SELECT count(*) AS total_reads, count(DISTINCT substr(r1_seq, 1, 12)) AS total_umis FROM fx_reads")
def read_umi_totals(t: Inputs) -> DataFrame:
    return r.read_umi_totals(t.fx_reads.select(F.substring("r1_seq", 1, 12).alias("umi")))


_PAIRS = "(SELECT DISTINCT cbc AS raw, concat(substr(cbc, 1, 15), 'A') AS corrected FROM fx_mols WHERE doublet_prediction = 'singlet') AS c"


def _tags(t: Inputs) -> DataFrame:
    tagged = t.fx_mols.where("doublet_prediction = 'singlet'").select("cbc", F.expr("concat(substr(cbc, 1, 15), 'A-1')").alias("CB"))
    return r.correction_pairs(tagged, "cbc", "CB")


@query("correct_barcodes", f"SELECT umi, coalesce(corrected, cbc) AS cbc, corrected IS NOT NULL AS matched FROM fx_mols LEFT JOIN {_PAIRS} ON cbc = raw")
def correct_barcodes(t: Inputs) -> DataFrame:
    return r.correct_barcodes(t.fx_mols.select("umi", "cbc"), _tags(t))


@query("cells_from_umis", f"SELECT DISTINCT corrected AS cell, concat(cbc, umi) AS umi FROM fx_mols JOIN {_PAIRS} ON cbc = raw")
def cells_from_umis(t: Inputs) -> DataFrame:
    return r.cells_from_umis(t.fx_mols.select(F.concat("cbc", "umi").alias("umi")), _tags(t))


@query("demux_by_suffix", """SELECT coalesce(name, 'undetermined') AS sample, count(*) AS umis FROM fx_mols LEFT JOIN
  (VALUES ('AC', 's1'), ('GT', 's2'), ('TA', 's3')) AS v(bc, name) ON right(umi, 2) = bc GROUP BY 1""")
def demux_by_suffix(t: Inputs) -> DataFrame:
    return r.demux_by_suffix(t.fx_mols, t.spark.createDataFrame([("AC", "s1"), ("GT", "s2"), ("TA", "s3")], "bc string, name string"), 2)


@query("demux_by_index", f"""SELECT read_id, CASE WHEN regexp_matches(r1_seq, '{s.fuzzy_pattern(ANCHOR)}') THEN sample_id END AS sample_id
  FROM (SELECT read_id, r1_seq, substr(r2_seq, 13, 6) AS idx FROM fx_reads) AS x LEFT JOIN
  (SELECT idx, concat('s_', idx) AS sample_id FROM (SELECT DISTINCT substr(r2_seq, 13, 6) AS idx FROM fx_reads) AS d WHERE right(idx, 1) IN ('A', 'C')) AS w USING (idx)""")
def demux_by_index(t: Inputs) -> DataFrame:
    pairs = t.fx_reads.withColumn("r2_seq", F.expr("substr(r2_seq, 13)"))
    samples = pairs.select(F.substring("r2_seq", 1, 6).alias("index")).distinct().where("right(index, 1) in ('A', 'C')").withColumn("sample_id", F.concat(F.lit("s_"), "index"))
    return r.demux_by_index(pairs, samples, ANCHOR).select("read_id", "sample_id")


@query("split_by_tag", """SELECT cbc, umi, coalesce(grp, 'undet') AS grp FROM fx_mols LEFT JOIN
  (SELECT cbc, min(concat('g', CAST(cluster AS STRING))) AS grp FROM fx_mols WHERE doublet_prediction = 'singlet' GROUP BY cbc) AS g USING (cbc)""")
def split_by_tag(t: Inputs) -> DataFrame:
    groups = t.fx_mols.where("doublet_prediction = 'singlet'").groupBy("cbc").agg(F.min(F.concat(F.lit("g"), F.col("cluster").cast("string"))).alias("grp"))
    return r.split_by_tag(t.fx_mols.select("cbc", "umi"), groups, "cbc")


@query("tag_read_ids", "SELECT concat(read_id, ':umi:', substr(r1_seq, 1, 12)) AS read_id, r2_seq, substr(r1_seq, 1, 12) AS umi FROM fx_reads")
def tag_read_ids(t: Inputs) -> DataFrame:
    return r.tag_read_ids(t.fx_reads, UMI)


@query("ingest_experiments", """WITH a AS (SELECT concat(cbc, '-', substr(sample_id, 2)) AS cbc, umi, raw_ibar, sample_id FROM fx_mols),
  v AS (SELECT cbc FROM a GROUP BY cbc HAVING count(*) >= 20), b AS (SELECT * FROM a WHERE cbc IN (SELECT cbc FROM v))
  SELECT * FROM b WHERE raw_ibar IN (SELECT raw_ibar FROM b GROUP BY 1 HAVING count(*) >= 3)""")
def ingest_experiments(t: Inputs) -> DataFrame:
    mols = t.fx_mols.select("cbc", "umi", "raw_ibar", "sample_id")
    batches = mols.select("sample_id").distinct().withColumn("batch", F.expr("substr(sample_id, 2)"))
    cells = mols.groupBy(F.concat_ws("-", "cbc", F.expr("substr(sample_id, 2)")).alias("cbc")).agg(F.count("*").alias("n")).where("n >= 20").select("cbc")
    frames = [mols.where(f"sample_id {op} 'S1'") for op in ("<=", ">")]
    return r.ingest_experiments(frames, batches, cells, 3).select("cbc", "umi", "raw_ibar", "sample_id")


@query("downsample_by_coverage", """WITH r AS (SELECT read_id, substr(r1_seq, 1, 12) AS umi FROM fx_reads), n AS (SELECT umi, count(*) AS n FROM r GROUP BY 1),
  q AS (SELECT quantile_cont(n, 0.1) AS q0, quantile_cont(n, 0.49) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.52) AS q3, quantile_cont(n, 0.9) AS q4 FROM n),
  b AS (SELECT umi, CASE WHEN n <= q0 THEN '10%' WHEN n > q1 AND n <= q3 OR n = q2 THEN '50%' WHEN n >= q4 THEN '90%' END AS bin FROM n, q),
  s AS (SELECT umi, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat('0:', umi)), umi) AS k FROM b WHERE bin IS NOT NULL) AS x WHERE k <= 30)
  SELECT umi, read_id, bin FROM r JOIN s USING (umi)""")
def downsample_by_coverage(t: Inputs) -> DataFrame:
    return r.downsample_by_coverage(t.fx_reads.select("read_id", F.substring("r1_seq", 1, 12).alias("umi")))


@query("downsample_per_group", """SELECT sample_id, cbc, umi, raw_ibar FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat('0:', umi)), umi, sample_id, cbc, raw_ibar) AS k FROM fx_mols) AS x
  WHERE k <= 20""")
def downsample_per_group(t: Inputs) -> DataFrame:
    return r.downsample_per_group(t.fx_mols.select("sample_id", "cbc", "umi", "raw_ibar"), 20, ["sample_id"], "umi")


