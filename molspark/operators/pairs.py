"""Pairs of rows inside groups, large groups dealt out by pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one task may meet with as many others.
BLOCK = 2000


def pairs_in_groups(rows: DataFrame, keys: list[str], id_col: str, left: dict[str, str], right: dict[str, str], block: int | None = None) -> DataFrame:
    """Each pair of rows of a group (equal ``keys``) once, the smaller ``id_col`` on the left; columns named by ``left`` and ``right`` (new name by column).

    A group of n rows is cut into n / ``block`` blocks by a hash of the id, and each pair of blocks is a join key of its own, so a hot group
    is met by many tasks.  Ids stand once in a group; null keys and ids meet nothing.
    """
    block = block or BLOCK
    many = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    dealt = rows.join(many, keys, "left").withColumn("__blocks", F.ceil(F.coalesce("__n", F.lit(1)) / block).cast("int")).withColumn("__mine", F.pmod(F.xxhash64(id_col), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    a = dealt.select(*keys, F.col("__mine").alias("__a"), F.col("__other").alias("__b"), F.col(id_col).alias("__left"), *(F.col(c).alias(n) for c, n in left.items()))
    b = dealt.select(*keys, F.col("__other").alias("__a"), F.col("__mine").alias("__b"), F.col(id_col).alias("__right"), *(F.col(c).alias(n) for c, n in right.items()))
    return a.join(b, [*keys, "__a", "__b"]).where("__left < __right").drop("__a", "__b", "__left", "__right")
