"""Queries of the cassette operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import fuzzy_pattern
from ..operators import cassette as c
from .constants import EDITED, END, METAS, START
from .queries_umi import reads
from .registry import Inputs, query

TARGETS = {"T1": "GACAGGTGTTCGTTG", "T2": "CAGACTGAGCACG"}
_R = "(SELECT substr(r1_seq, 1, 12) AS umi, substr(r1_seq, 13, 6) AS sbc, r2_seq AS seq, read_id FROM fx_reads) AS r"


def _swapped(col: str, rules: list) -> str:
    for meta, old, new in rules:
        col = f"regexp_replace({col}, '({meta})(.*?)({old})(.*$)', '\\1\\2{new}\\4')"
    return col


def _flanks(col: str, rules: list) -> str:
    for meta, left, right, nl, nr in rules:
        col = f"regexp_replace({col}, '({meta})(.*?)({left})(.{{0,5}})({right})(.*$)', '\\1\\2{nl}\\4{nr}\\6')"
    return col


_RULES, _FRULES = c.mask_rules(METAS, TARGETS), c.flank_rules(METAS, EDITED)
_BACK = [(m, new, old) for m, old, new in _RULES]
_FBACK = [(m, nl, nr, left, right) for m, left, right, nl, nr in _FRULES]


@query("mask_repeats", f"SELECT read_id, {_swapped('r2_seq', _RULES)} AS r2_seq FROM fx_reads")
def mask_repeats(t: Inputs) -> DataFrame:
    return c.mask_repeats(t.fx_reads.select("read_id", "r2_seq"), METAS, TARGETS, "r2_seq")


@query("unmask_repeats", f"SELECT read_id, {_swapped('masked', _BACK)} AS r2_seq FROM (SELECT read_id, {_swapped('r2_seq', _RULES)} AS masked FROM fx_reads) AS m")
def unmask_repeats(t: Inputs) -> DataFrame:
    return c.unmask_repeats(mask_repeats(t), METAS, TARGETS, "r2_seq")


@query("mask_flanks", f"SELECT read_id, {_flanks('r2_seq', _FRULES)} AS r2_seq FROM fx_reads")
def mask_flanks(t: Inputs) -> DataFrame:
    return c.mask_flanks(t.fx_reads.select("read_id", "r2_seq"), METAS, EDITED, "r2_seq")


@query("unmask_flanks", f"SELECT read_id, {_flanks('masked', _FBACK)} AS r2_seq FROM (SELECT read_id, {_flanks('r2_seq', _FRULES)} AS masked FROM fx_reads) AS m")
def unmask_flanks(t: Inputs) -> DataFrame:
    return c.unmask_flanks(mask_flanks(t), METAS, EDITED, "r2_seq")


_ABERRANT = " OR ".join(f"len(regexp_extract_all(r2_seq, '{m}')) > 1" for m in METAS.values())


@query("flag_aberrant", f"SELECT read_id, {_ABERRANT} AS is_aberrant FROM fx_reads")
def flag_aberrant(t: Inputs) -> DataFrame:
    return c.flag_aberrant(t.fx_reads.select("read_id", "r2_seq"), METAS, "r2_seq").select("read_id", "is_aberrant")


def _clean(col: str) -> str:
    for text in [*METAS.values(), START, END]:
        col = f"regexp_replace({col}, '{fuzzy_pattern(text)}', '{text}', 'g')"
    return col


_NAME = "CASE {x} " + " ".join(f"WHEN '{s}' THEN '{n}'" for n, s in METAS.items()) + " END"
_FIRST = "least(" + ", ".join(f"CASE WHEN strpos(s, '{m}') > strpos(s, '{START}') THEN strpos(s, '{m}') END" for m in METAS.values()) + ")"
_LAST = "greatest(" + ", ".join(f"CASE WHEN strpos(s, '{m}') BETWEEN 1 AND strpos(s, '{END}') - 1 THEN strpos(s, '{m}') END" for m in METAS.values()) + ")"
_SEGMENTS = f"""(WITH s AS (SELECT umi, sbc, {_clean('seq')} AS s FROM {_R}), h AS (SELECT *, regexp_extract_all(s, '{'|'.join(METAS.values())}') AS hits FROM s),
  p AS (SELECT umi, sbc, s, hits[i] AS a, hits[i + 1] AS b FROM (SELECT *, unnest(range(1, len(hits))) AS i FROM h) AS x)
  SELECT umi, sbc, {_NAME.format(x='a')} AS start_meta, {_NAME.format(x='b')} AS end_meta,
    CASE WHEN strpos(s, b) + 20 > strpos(s, a) THEN substr(s, strpos(s, a), strpos(s, b) + 20 - strpos(s, a)) ELSE '' END AS segment_seq FROM p
  UNION ALL SELECT umi, sbc, '_CASSETTE_START_', {_NAME.format(x='substr(s, f, 20)')}, substr(s, strpos(s, '{START}'), f - strpos(s, '{START}') + 20)
    FROM (SELECT *, {_FIRST} AS f FROM s) AS q WHERE strpos(s, '{START}') > 0 AND f IS NOT NULL
  UNION ALL SELECT umi, sbc, {_NAME.format(x='substr(s, l, 20)')}, '_CASSETTE_END_', substr(s, l, strpos(s, '{END}') - l + {len(END)})
    FROM (SELECT *, {_LAST} AS l FROM s) AS q WHERE strpos(s, '{END}') > 0 AND l IS NOT NULL) AS seg"""


def segments(t: Inputs) -> DataFrame:
    return c.segment_by_metas(reads(t), METAS, START, END, "seq", ["umi", "sbc"])


@query("segment_by_metas", f"SELECT * FROM {_SEGMENTS}")
def segment_by_metas(t: Inputs) -> DataFrame:
    return segments(t)


@query("assemble_segmented")
def assemble_segmented(t: Inputs) -> DataFrame:
    return c.assemble_segmented(reads(t), METAS, EDITED, START, END, groups=["umi"], col="seq", k=13)


_SEQ = "CASE {x} " + " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in METAS.items()) + " END"
_CHECK = f"(contains(contig, right({_SEQ.format(x='start_meta')}, 12)) AND contains(contig, left({_SEQ.format(x='end_meta')}, 12)))"
_ASM = """(SELECT umi, start_meta, end_meta, CASE WHEN right(umi, 1) IN ('1', '3', '5') THEN substr(min(segment_seq), 15) ELSE min(segment_seq) END AS contig FROM fx_segments GROUP BY 1, 2, 3) AS asm"""


def assembled(t: Inputs) -> DataFrame:
    one = t.fx_segments.groupBy("umi", "start_meta", "end_meta").agg(F.min("segment_seq").alias("m"))
    cut = F.when(F.col("umi").rlike("[135]$"), F.expr("substr(m, 15)")).otherwise(F.col("m"))
    return c.validate_assembly(one.select("umi", "start_meta", "end_meta", cut.alias("contig")), METAS, 12)


@query("validate_assembly", f"SELECT *, {_CHECK} AS is_valid FROM {_ASM}")
def validate_assembly(t: Inputs) -> DataFrame:
    return assembled(t)


@query("fallback_consensus", f"""WITH v AS (SELECT umi, start_meta, end_meta, contig AS segment_seq, false AS is_fallback FROM {_ASM} WHERE {_CHECK}),
  n AS (SELECT umi, start_meta, end_meta, segment_seq, count(*) AS n FROM fx_segments ANTI JOIN v USING (umi, start_meta, end_meta) GROUP BY 1, 2, 3, 4)
  SELECT * FROM v UNION ALL SELECT umi, start_meta, end_meta, segment_seq, true FROM (SELECT *, row_number() OVER (PARTITION BY umi, start_meta, end_meta ORDER BY n DESC, segment_seq) AS k FROM n) AS z WHERE k = 1""")
def fallback_consensus(t: Inputs) -> DataFrame:
    return c.fallback_consensus(t.fx_segments, assembled(t), ["umi", "start_meta", "end_meta"])


_INS = ", ".join(f"CASE WHEN regexp_matches({{x}}, '{a[-8:]}(.{{{{0,6}}}}?){b[:8]}') THEN regexp_extract({{x}}, '{a[-8:]}(.{{{{0,6}}}}?){b[:8]}', 1) END AS \"{n}_ins\"" for n, (a, b) in EDITED.items())


@query("target_insertions", f"SELECT read_id, {_INS.format(x='r2_seq')} FROM fx_reads")
def target_insertions(t: Inputs) -> DataFrame:
    return c.target_insertions(t.fx_reads, EDITED, "r2_seq").select("read_id", *(f"{n}_ins" for n in EDITED))


_ORDER = "CASE start_meta WHEN '_CASSETTE_START_' THEN -1 " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(METAS)) + " END"


@query("stitch_segments", f"""SELECT umi, string_agg(CASE WHEN o = first THEN segment_seq ELSE substr(segment_seq, 21) END, '' ORDER BY o, end_meta, segment_seq) AS stitched_seq
  FROM (SELECT *, min(o) OVER (PARTITION BY umi) AS first FROM (SELECT *, {_ORDER} AS o FROM fx_segments) AS a) AS b GROUP BY umi""")
def stitch_segments(t: Inputs) -> DataFrame:
    return c.stitch_segments(t.fx_segments, list(METAS), ["umi"])


_TYPES = """(SELECT start_meta, end_meta, count(*) AS count, avg(length(s)) AS mean_length, quantile_cont(length(s), 0.5) AS median_length
  FROM (SELECT umi, start_meta, end_meta, min(segment_seq) AS s FROM fx_segments GROUP BY 1, 2, 3) AS o GROUP BY 1, 2) AS types"""


@query("segment_types", f"SELECT start_meta, end_meta, count, round(mean_length, 9) AS mean_length, median_length FROM {_TYPES}")
def segment_types(t: Inputs) -> DataFrame:
    return c.segment_types(t.fx_segments, ["umi"]).withColumn("mean_length", F.round("mean_length", 9))


_HET = """(SELECT mode, n_transition_types, count(*) AS molecules FROM (SELECT umi, 'sensitive' AS mode, count(*) AS n_transition_types FROM (SELECT DISTINCT umi, start_meta, end_meta FROM fx_segments) AS d GROUP BY 1
  UNION ALL SELECT umi, 'smart', count(*) FROM (SELECT umi, n, max(n) OVER (PARTITION BY umi) AS top FROM (SELECT umi, start_meta, end_meta, count(*) AS n FROM fx_segments GROUP BY 1, 2, 3) AS a) AS b WHERE n >= 0.4 * top GROUP BY 1) AS u GROUP BY 1, 2) AS het"""


@query("transition_heterogeneity", f"SELECT * FROM {_HET}")
def transition_heterogeneity(t: Inputs) -> DataFrame:
    return c.transition_heterogeneity(t.fx_segments, ["umi"], 0.4)


_PRESENCE = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST(sum(CAST(contains(contig, '{s}') AS INT)) AS BIGINT) AS contigs, round(100 * avg(CAST(contains(contig, '{s}') AS INT)), 9) AS percent FROM contigs" for n, s in {**METAS, "start": START, "end": END}.items())


@query("meta_presence", f"WITH contigs AS (SELECT r2_seq AS contig FROM fx_reads) {_PRESENCE}")
def meta_presence(t: Inputs) -> DataFrame:
    out = c.meta_presence(t.fx_reads.select(F.col("r2_seq").alias("contig")), {**METAS, "start": START, "end": END})
    return out.withColumn("percent", F.round("percent", 9))


@query("segmentation_report", f"""SELECT 'totals' AS section, 'segments' AS key, CAST(count(*) AS DOUBLE) AS value FROM fx_segments UNION ALL SELECT 'totals', 'molecules', count(DISTINCT umi) FROM fx_segments
  UNION ALL SELECT 'totals', 'consecutive', count(*) FROM fx_segments UNION ALL SELECT 'totals', 'edges', 0 UNION ALL SELECT 'transitions', concat(start_meta, '>', end_meta), count FROM {_TYPES}
  UNION ALL SELECT 'heterogeneity', concat(mode, ':', CAST(n_transition_types AS STRING)), molecules FROM {_HET}
  UNION ALL SELECT 'segments_per_molecule', k, v FROM (SELECT unnest(['mean', 'median', 'min', 'max']) AS k, unnest([round(avg(n), 9), quantile_cont(n, 0.5), min(n), max(n)]) AS v FROM (SELECT count(*) AS n FROM fx_segments GROUP BY umi) AS c) AS s
  UNION ALL SELECT 'assembly', concat(start_meta, '>', end_meta), round(100 * avg(CAST(length(contig) > 60 AS INT)), 9) FROM {_ASM} GROUP BY 2 UNION ALL SELECT 'assembly', 'all', round(100 * avg(CAST(length(contig) > 60 AS INT)), 9) FROM {_ASM}
  UNION ALL SELECT 'contigs', 'contigs', count(*) FROM fx_reads UNION ALL SELECT 'contigs', 'mean', round(avg(length(r2_seq)), 9) FROM fx_reads UNION ALL SELECT 'contigs', 'median', quantile_cont(length(r2_seq), 0.5) FROM fx_reads
  UNION ALL SELECT 'presence', feature, percent FROM (WITH contigs AS (SELECT r2_seq AS contig FROM fx_reads) {_PRESENCE}) AS p WHERE feature LIKE 'META%'""")
def segmentation_report(t: Inputs) -> DataFrame:
    out = c.segmentation_report(t.fx_segments, t.fx_reads.select(F.col("r2_seq").alias("contig")), METAS, ["umi"], 0.4, assembled(t).withColumn("contig", F.when(F.length("contig") > 60, F.col("contig"))))
    return out.withColumn("value", F.round("value", 9))


_PCT = ", ".join(f"round(coalesce(sum(CASE WHEN end_meta = '{e}' THEN 100 * count / total END), 0), 9) AS \"{e}\"" for e in [*METAS, "_CASSETTE_END_"])


@query("transition_matrix", f"SELECT start_meta, {_PCT} FROM (SELECT *, sum(count) OVER () AS total FROM {_TYPES}) AS z GROUP BY 1")
def transition_matrix(t: Inputs) -> DataFrame:
    m = c.transition_matrix(c.segment_types(t.fx_segments, ["umi"]), list(METAS))
    return m.select("start_meta", *(F.round(e, 9).alias(e) for e in m.columns[1:]))


@query("meta_frequency_filter", f"""WITH types AS (SELECT * FROM {_TYPES}), f AS (SELECT m, sum(count) AS n FROM (SELECT start_meta AS m, count FROM types UNION ALL SELECT end_meta, count FROM types) AS x GROUP BY 1),
  k AS (SELECT m FROM (SELECT m, n, sum(n) OVER () AS total FROM f) AS y WHERE 100 * n / total >= 20.0) SELECT start_meta, end_meta, count FROM types WHERE start_meta IN (SELECT m FROM k) AND end_meta IN (SELECT m FROM k)""")
def meta_frequency_filter(t: Inputs) -> DataFrame:
    return c.meta_frequency_filter(c.segment_types(t.fx_segments, ["umi"]), 20.0).select("start_meta", "end_meta", "count")


@query("segments_to_alleles", f"""WITH e AS (SELECT umi, concat('r', right(start_meta, 1)) AS site, {_INS.format(x='segment_seq')} FROM fx_segments WHERE start_meta <> end_meta),
  n AS (SELECT umi, site, "RNF2_ins" AS ins, count(*) AS n FROM e WHERE "RNF2_ins" IS NOT NULL GROUP BY 1, 2, 3),
  k AS (SELECT umi, site, ins FROM (SELECT *, row_number() OVER (PARTITION BY umi, site ORDER BY n DESC, ins) AS k, sum(n) OVER (PARTITION BY umi, site) AS total FROM n) AS z WHERE k = 1 AND n >= 0.5 * total)
  SELECT umi, max(CASE WHEN site = 'r1' THEN ins END) AS r1, max(CASE WHEN site = 'r2' THEN ins END) AS r2, max(CASE WHEN site = 'r3' THEN ins END) AS r3 FROM k GROUP BY 1""")
def segments_to_alleles(t: Inputs) -> DataFrame:
    places = {(a, b): [(f"r{a[-1]}", "RNF2")] for a in METAS for b in METAS if a != b}
    return c.segments_to_alleles(t.fx_segments, places, EDITED, ["umi"])
