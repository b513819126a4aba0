"""The column functions as SQL functions of a session, for queries in SQL text.

They are SQL-defined: Spark puts their bodies in place of the calls, so plans hold built-in expressions alone, with no Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sequence import COMPLEMENT_FROM, COMPLEMENT_TO

#: (signature, type, body) of each function.
DEFINITIONS = (
    ("reverse_complement(seq STRING)", "STRING", f"reverse(translate(seq, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}'))"),
    ("hamming(a STRING, b STRING)", "INT", """CASE WHEN length(a) = length(b) THEN
       size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), d -> d)) END"""),
    ("mean_quality(qual STRING)", "DOUBLE", "CASE WHEN qual <> '' THEN (aggregate(split(qual, ''), 0, (s, c) -> s + ascii(c)) - 33 * length(qual)) / length(qual) END"),
    ("gc_share(seq STRING)", "DOUBLE", "CASE WHEN seq <> '' THEN (length(seq) - length(replace(replace(replace(replace(seq, 'G'), 'C'), 'g'), 'c'))) / length(seq) END"),
    ("kmers(seq STRING, k INT)", "ARRAY<STRING>",  # a place in bytes is found at once, one in letters by going through the text
     """CASE WHEN k > 0 AND length(seq) >= k THEN
       CASE WHEN octet_length(seq) = length(seq) THEN transform(array(cast(seq AS BINARY)), b -> transform(sequence(1, octet_length(b) - k + 1), i -> cast(substr(b, i, k) AS STRING)))[0]
            ELSE regexp_extract_all(seq, concat('(?s)(?=(.{', k, '})).'), 1) END
     WHEN seq IS NOT NULL THEN cast(array() AS ARRAY<STRING>) END"""),
    ("between_anchors(seq STRING, first STRING, last STRING)", "STRING",
     "CASE WHEN instr(seq, first) > 0 AND locate(last, seq, instr(seq, first) + length(first)) > 0 THEN substr(seq, instr(seq, first) + length(first), locate(last, seq, instr(seq, first) + length(first)) - instr(seq, first) - length(first)) END"),
)


def register(spark: SparkSession) -> list[str]:
    """Define the functions in this session, and return their names.

    ``hamming`` is null for strings of different lengths, ``mean_quality`` and ``gc_share`` for empty ones, ``between_anchors``, the text between the first
    ``first`` and the next ``last``, where one of them is missing; ``kmers`` of a text that is too short is empty.  Null arguments give null.
    """
    for signature, kind, body in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature, _, _ in DEFINITIONS]
