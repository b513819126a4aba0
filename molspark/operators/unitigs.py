"""Unitigs of de Bruijn graphs of any size: chains of edges are joined by pointer jumping over tables, so no graph must fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Letters of a chain that are put together first.
PIECE = 4096


def _jump(state: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """Rows that aren't done point to where the row that they point to points."""
    ahead = state.select("g", F.col("edge").alias("ptr"), *(F.col(c).alias(f"{c}2") for c in ("ptr", "done", *carry)))
    moved = state.where("NOT done").join(ahead, ["g", "ptr"]).select("g", "edge", F.col("ptr2").alias("ptr"), F.col("done2").alias("done"), *(v.alias(c) for c, v in carry.items()))
    return state.where("done").unionByName(moved)


def _settle(links: DataFrame) -> DataFrame:
    """Each edge's first edge of its chain (``ptr``) and the steps from there (``dist``); rows on rings stay without ``done``.

    ``links`` (g, edge, pred): the only edge before it, null at a chain's first.  Each round doubles the steps that pointers reach, so rounds follow the logarithm
    of the longest chain.  As long as a chain has open rows some of them become done, so a round that closes none has only rings left.
    """
    state = materialise(links.select("g", "edge", F.coalesce("pred", "edge").alias("ptr"), F.col("pred").isNull().alias("done"), F.col("pred").isNotNull().cast("long").alias("dist")), "chain-step")
    left = state.where("NOT done").count()
    while left:
        state = materialise(_jump(state, {"dist": F.col("dist") + F.col("dist2")}), "chain-step")
        before, left = left, state.where("NOT done").count()
        if left == before:
            break
    return state


def _cut_rings(links: DataFrame) -> DataFrame:
    """Chains of rings, each from its smallest node on, without the edge that leads back to it.

    Pointers run round the ring and carry the smallest node passed.  Where a round changes none, stretches of one length that
    together go all the way round have the same smallest node, so it is the ring's.
    """
    state = materialise(links.select("g", "edge", F.col("pred").alias("ptr"), F.lit(False).alias("done"), F.col("src").alias("low"), F.lit(True).alias("new")), "ring-step")
    while state.where("new").limit(1).count():
        state = materialise(_jump(state, {"low": F.least("low", "low2"), "new": F.col("low2") < F.col("low")}), "ring-step")
    cut = links.join(state.select("g", "edge", "low"), ["g", "edge"]).where("dst <> low")
    return cut.withColumn("pred", F.when(F.col("src") != F.col("low"), F.col("pred")))


def longest_unitigs(edges: DataFrame) -> DataFrame:
    """``g, contig``: the longest text along nodes with one way in and one way out, of each graph ``g`` of distinct edges (g, src, dst); ties by text.

    A ring is read from its smallest node to the last one before it.  ``g`` isn't null.
    """
    e = edges.select("g", "src", "dst", F.concat("src", F.right("dst", F.lit(1))).alias("edge"))
    ways_in, ways_out = (e.groupBy("g", F.col(c).alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("g", "node") for c in ("dst", "src"))
    inside = ways_in.join(ways_out, ["g", "node"])
    into = e.select("g", F.col("dst").alias("node"), F.col("edge").alias("pred")).join(inside, ["g", "node"])
    links = materialise(e.join(into.withColumnRenamed("node", "src"), ["g", "src"], "left"), "chain-links")
    state = _settle(links)
    chains = state.where("done")
    rings = state.where("NOT done").select("g", "edge")
    if not rings.isEmpty():
        chains = chains.unionByName(_settle(materialise(_cut_rings(links.join(rings, ["g", "edge"])), "ring-links")).where("done"))
    sizes = chains.groupBy("g", "ptr").agg(F.max("dist").alias("last"))
    longest = sizes.join(sizes.groupBy("g").agg(F.max("last").alias("last")), ["g", "last"]).select("g", "ptr")

    def in_order(at: str, text: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), text.alias("text")))), lambda x: x["text"]), "")

    pieces = chains.join(longest, ["g", "ptr"]).withColumn("piece", F.floor(F.col("dist") / PIECE)).groupBy("g", "ptr", "piece").agg(in_order("dist", F.right("edge", F.lit(1))).alias("text"))
    texts = pieces.groupBy("g", "ptr").agg(in_order("piece", F.col("text")).alias("text"))
    best = texts.groupBy("g").agg(F.min(F.concat(F.expr("left(ptr, length(ptr) - 1)"), "text")).alias("contig"))
    lone = e.groupBy("g").agg(F.min("src").alias("node"))  # a graph of nodes that lead to themselves alone has no chain
    return lone.join(best, "g", "left").select("g", F.coalesce("contig", "node").alias("contig"))
