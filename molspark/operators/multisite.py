"""Multi-site integrations and sample sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import extract_or_null, fuzzy_regex, hamming, reverse_complement
from .umi import pieces


def anchored(col: str, anchor1: str, length: int, anchor2: str, wildcard: str = ".{0,1}") -> Column:
    """The ``length`` bases between two anchors with one error each; null without both."""
    return extract_or_null(F.col(col), f"(?:{fuzzy_regex(anchor1, wildcard)})(.{{{length}}})(?:{fuzzy_regex(anchor2, wildcard)})", 1)


def integration_detect(reads: DataFrame, col: str, anchor1: str, length: int, anchor2: str, top: int | None = None) -> DataFrame:
    """Barcodes between the anchors by reads; the first ``top``, or all within a decade of the most frequent."""
    n = reads.select(anchored(col, anchor1, length, anchor2).alias("intid")).where("intid is not null").groupBy("intid").agg(F.count("*").alias("n"))
    if top is not None:
        return n.orderBy(F.desc("n"), "intid").limit(top)
    best = n.agg(F.max("n").alias("best"))
    return n.crossJoin(F.broadcast(best)).where(F.floor(F.log10("n")) > F.floor(F.log10("best")) - 1).drop("best")


def valid_pairs(pairs: DataFrame, orderm: float = 1.0) -> DataFrame:
    """(intid1, intid2) by distinct UMIs, those within ``orderm`` decades of the most frequent."""
    n = pairs.where("intid1 is not null and intid2 is not null").groupBy("intid1", "intid2").agg(F.countDistinct("umi").alias("umis"))
    best = n.agg(F.max("umis").alias("best"))
    return n.crossJoin(F.broadcast(best)).where(F.log10("umis") >= F.log10("best") - orderm).drop("best")


def split_by_integration(pairs: DataFrame, valid: DataFrame, most: int = 3) -> DataFrame:
    """Read pairs with their class: the valid pair they hold, ``chimeric`` if both ids are valid apart, else ``undetermined``.

    An id that isn't listed stands for the nearest listed one of its length within ``most`` substitutions: two such ids share one of
    ``most`` + 1 pieces, on which they are joined.
    """
    ids = {k: valid.select(F.col(f"intid{k}").alias("id")).distinct() for k in (1, 2)}
    out = pairs
    for k in (1, 2):
        raw = pairs.select(F.col(f"intid{k}").alias("raw")).where("raw is not null").distinct()
        d = hamming(F.col("raw"), F.col("id"))
        left, right = (df.withColumn("__piece", F.explode(pieces(c, most + 1))) for df, c in ((raw, "raw"), (ids[k], "id")))
        near = left.join(right, "__piece").where((F.length("raw") == F.length("id")) & (d <= most)).groupBy("raw").agg(F.min(F.struct(d.alias("d"), "id")).alias("b")).select(F.col("raw").alias(f"intid{k}"), F.col("b.id").alias(f"id{k}"))
        out = out.join(near, f"intid{k}", "left")
    listed = valid.select(F.col("intid1").alias("id1"), F.col("intid2").alias("id2"), F.lit(True).alias("listed")).distinct()
    cls = F.when(F.col("listed"), F.concat_ws(":", "id1", "id2")).when(F.col("id1").isNotNull() & F.col("id2").isNotNull(), "chimeric").otherwise("undetermined")
    return out.join(listed, ["id1", "id2"], "left").withColumn("class", cls).drop("listed")


def split_by_coverage(pairs: DataFrame, min_cov: float) -> DataFrame:
    """Pairs of integration ids with at least ``min_cov`` times the reads of the most frequent pair: ``intid1, intid2, reads``."""
    n = pairs.where("intid1 is not null and intid2 is not null").groupBy("intid1", "intid2").agg(F.count("*").alias("reads"))
    return n.crossJoin(F.broadcast(n.agg(F.max("reads").alias("best")))).where(F.col("reads") >= F.lit(float(min_cov)) * F.col("best")).drop("best")


def sample_sheet(primers: DataFrame, upstream: str, downstream: str, length: int = 8, i5_rc: bool = False, plate: str | None = None) -> DataFrame:
    """All combinations of i5 and i7 primers with their indices: ``i5_id, i7_id, index, index2``; i7 is always reversed, i5 by option.

    The sheet has a few dozen primers; all combinations are the result asked for.  With a ``plate`` column, all combinations inside each plate.
    """
    p = primers.withColumn("primer", F.regexp_extract("id", "^PO_([0-9]+)", 1)).withColumn("idx", F.substring(F.regexp_extract(F.upper("seq"), f"{upstream}(.+?){downstream}", 1), 1, length))
    key = [plate] if plate else []
    i5 = p.where("primer_end = 'i5'").select(*key, F.col("primer").alias("i5_id"), (reverse_complement("idx") if i5_rc else F.col("idx")).alias("index2"))
    i7 = p.where("primer_end = 'i7'").select(*key, F.col("primer").alias("i7_id"), reverse_complement("idx").alias("index"))
    return i5.join(i7, key) if plate else i5.crossJoin(i7)
