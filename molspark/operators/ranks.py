"""Ranks over all rows of a table without bringing them together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .intervals import free_names


def global_rank(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their place from 1 in the given order, as ``name``; rows with equal keys stand in no given order.

    Rows are dealt to range partitions; a place is that within its partition and the rows of all partitions before it, whose counts, a row a
    partition, are summed up.  No task sees more than its range.
    """
    part, before, *keys = free_names(rows, "part", "before", *(f"key{i}" for i in range(len(order))))
    keyed = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys)
    dealt = materialise(keyed.withColumn(part, F.spark_partition_id()), "rank")
    counts = dealt.groupBy(part).agg(F.count("*").alias(before))
    upto = counts.withColumn(before, F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    own = F.row_number().over(Window.partitionBy(part).orderBy(*keys))
    return dealt.withColumn(name, own).join(upto, part).withColumn(name, (F.col(name) + F.col(before)).cast("int")).drop(part, before, *keys)
