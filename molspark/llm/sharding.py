"""Sharding: global byte-size prefix sums cut at equal targets (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, stage


def balanced_shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text",
                    row_overhead: int = 16, n_parts: int | None = None) -> DataFrame:
    """Deal rows into ``n_shards`` contiguous shards of near equal byte size.

    Rows stand in the order of (id, text hash).  They are range-partitioned in that order, each
    partition sums its own sizes, a prefix sum over the partition totals (one row a partition)
    gives every partition its global start, and a running sum inside each partition gives every row
    the global interval of bytes it covers.  The row goes to the shard that holds the middle of its
    interval, so shard sizes differ by no more than one row's size.  Row order, and with it the
    result, depends on the data alone, not on how many partitions there are.

    Size is the UTF-8 bytes of the text (null text: none) plus ``row_overhead``.  The range key ends in a
    row number of the staged slim table, so a repeated or null id never makes a partition that
    can't be split.  Equal rows are interchangeable.  No rows give no rows; an empty text has size
    ``row_overhead``.

    Returns ``doc_id, size, text_crc32, shard, slot`` (slot: position in the shard, from 0).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    slim = stage(
        id_and_text(docs, id_col, text_col).select(
            "doc_id", (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.md5(text).alias("h"),
            F.monotonically_increasing_id().alias("uid")),
        "shard-slim")
    order = ["doc_id", "h", "uid"]
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(slim.repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = (rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
              .select("part", F.coalesce(F.sum("part_bytes").over(before), zero).alias("bytes_before"),
                      F.coalesce(F.sum("part_rows").over(before), zero).alias("rows_before"),
                      F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes")))
    # one row a partition: at most n_parts rows, whatever the input
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("bytes_before") + F.sum("size").over(inside)
    placed = rows.join(F.broadcast(starts), "part").withColumns({
        "twice_middle": 2 * end - F.col("size"),
        "n": F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1,
    })
    placed = placed.withColumn("shard", F.least(
        F.lit(n_shards - 1), F.expr(f"twice_middle * {n_shards} div (2 * all_bytes)")).cast("int"))
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard", "n"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("n").alias("first_n"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("n") - F.col("first_n")).alias("slot"))
