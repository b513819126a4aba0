"""Range joins: intervals that overlap, met by bins of a fixed width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Rows of one bin that a task may meet; a fuller bin is dealt to as many parts as it needs.
BIN_ROWS = 1_000_000


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int = 1000,
                  bin_rows: int | None = None) -> DataFrame:
    """Rows of both sides with equal ``on`` columns whose closed intervals overlap, each pair once.

    Both sides are exploded to the bins of ``width`` that their intervals touch and joined on (``on``, bin); an exact test follows, and a pair that
    meets in several bins counts in the first.  So no join is on ``on`` alone, however many intervals a chromosome has.  A bin with more than
    ``bin_rows`` rows on the left is dealt to parts by a hash of the row, which the right side's few rows there all meet.  Null or
    reversed intervals and null ``on`` columns meet nothing.  Columns of ``right`` that ``left`` has too, but for ``on``, must be renamed first.
    """
    bin_rows = bin_rows or BIN_ROWS
    lo, hi, bin_, part, parts, lo2, hi2 = free_names(left.join(right.limit(0), on), "lo", "hi", "bin", "part", "parts", "lo2", "hi2")

    def binned(df: DataFrame, span: tuple[Column, Column], a: str, b: str) -> DataFrame:
        df = df.withColumns({a: span[0].cast("long"), b: span[1].cast("long")}).where(F.col(a) <= F.col(b))
        return df.withColumn(bin_, F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))

    a, b = binned(left, left_span, lo, hi), binned(right, right_span, lo2, hi2)
    full = a.groupBy(*on, bin_).agg(F.ceil(F.count("*") / bin_rows).cast("int").alias(parts)).where(F.col(parts) > 1)
    full = materialise(full, "full-bins")  # a row for each BIN_ROWS of the left side at most
    many = F.coalesce(F.col(parts), F.lit(1))
    a = a.join(full, [*on, bin_], "left").withColumn(part, F.pmod(F.xxhash64(*left.columns), many).cast("int")).drop(parts)
    b = b.join(full, [*on, bin_], "left").withColumn(part, F.explode(F.sequence(F.lit(0), many - 1))).drop(parts)
    met = a.join(b, [*on, bin_, part])
    first = F.floor(F.greatest(F.col(lo), F.col(lo2)) / width)
    return met.where((F.col(lo) <= F.col(hi2)) & (F.col(lo2) <= F.col(hi)) & (F.col(bin_) == first)).select(
        *(F.col(f"`{c}`") for c in [*left.columns, *(c for c in right.columns if c not in on)]))
