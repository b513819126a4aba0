"""Compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import align_distinct
from .alleles import lineage_vector
from .umi import umi_correct, umi_dominant_seq


def bin_alleles(reads: DataFrame, ref: str, intervals: list[tuple[str, int, int]], anchor: str, anchor_end: str, *, errors: int = 1, min_reads: int = 1, anchor_errors: int = 0) -> DataFrame:
    """Reads (umi, seq) to one lineage barcode a molecule: UMIs corrected, dominant sequence, aligned to ``ref``, coded by interval."""
    molecules = umi_dominant_seq(umi_correct(reads, errors)).where(F.col("reads_per_umi") >= min_reads)
    pairs = molecules.select("umi", "reads_per_umi", F.col("dominant_seq").alias("seq"), F.lit(ref).alias("ref"))
    aligned = pairs.join(align_distinct(pairs), ["seq", "ref"])
    return lineage_vector(aligned, intervals, anchor, anchor_end, anchor_errors=anchor_errors).select("umi", F.col("reads_per_umi").alias("reads"), "cigar_str", "alignment_score", "barcode")
