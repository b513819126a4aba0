"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, stage


def _least(e: DataFrame) -> DataFrame:
    return stage(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, v`` long pairs -> ``u, root``: for every node of an edge the smallest node it is connected with.

    Each step is a minimum by node (combined before the shuffle) and a join; a node's neighbours are never
    gathered, and those of a node with very many are not shuffled.  The result of each step is stored, so nothing is recomputed, and the loop ends when the edges
    stay the same, after a number of steps that grows with the logarithm of the longest chain.  Loops and
    repeated edges are ignored; a null end drops the edge; no edges give no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u != v").distinct()
    e, before = stage(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            return e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("m", "u"))
        large = join_unique(both, least, "u", "degree", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large-star")
        joined = join_unique(large, _least(large), "u", "degree", now[0])
        links = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = joined.select(F.explode(links).alias("link")).select("link.u", "link.v").where("u != v")
        e = stage(small.distinct(), "small-star")
