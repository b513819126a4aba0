"""Barcodes corrected through dictionaries of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .intervals import free_names

#: A dictionary of up to this many bytes, measured, is sent to every executor.
MAP_BYTES = 32 << 20
#: Bytes of one entry beside its two texts.
ENTRY_BYTES = 64
#: Rows of one raw barcode that a task may meet; those of a more frequent one are dealt to parts.
KEY_ROWS = 1_000_000


def correct_by_dictionary(df: DataFrame, dictionary: DataFrame, col: str, out: str, missing: str | None = None, map_bytes: int | None = None,
                          key_rows: int | None = None) -> DataFrame:
    """``df`` with ``out``, the entry of ``col`` in ``dictionary`` (raw, corrected), or ``missing``; no row is lost or doubled.

    Of several entries of one raw barcode the smallest counts; null ones and a null ``col`` have none.  The dictionary is stored and measured: up to
    ``map_bytes`` it is a map that every task looks up, with no shuffle of ``df``.  A larger one is joined by shuffle, where a barcode of more than
    ``key_rows`` rows is dealt to parts, which its one entry meets in all.
    """
    map_bytes, key_rows = MAP_BYTES if map_bytes is None else map_bytes, key_rows or KEY_ROWS
    raw, new, part, parts = free_names(df, "raw", "corrected", "part", "parts")
    d = dictionary.where("raw IS NOT NULL AND corrected IS NOT NULL").groupBy(F.col("raw").alias(raw)).agg(F.min("corrected").alias(new))
    d = materialise(d, "dictionary")
    size = d.agg(F.sum(F.octet_length(raw) + F.octet_length(new) + ENTRY_BYTES)).first()[0] or 0
    found = F.coalesce(F.col(new), F.lit(missing).cast("string"))
    if size <= map_bytes:
        return df.join(F.broadcast(d), F.col(f"`{col}`") == F.col(raw), "left").withColumn(out, found).drop(raw, new)
    hot = df.groupBy(F.col(f"`{col}`").alias(raw)).agg(F.ceil(F.count("*") / key_rows).cast("int").alias(parts)).where(F.col(parts) > 1)
    hot = materialise(hot, "hot-barcodes")  # a row for each key_rows rows at most
    many = F.coalesce(F.col(parts), F.lit(1))
    entries = d.join(hot, raw, "left").withColumn(part, F.explode(F.sequence(F.lit(0), many - 1))).drop(parts)
    key, dealt, n = free_names(df.join(entries.limit(0)), "key", "dealt", "n")
    rows = df.join(hot.select(F.col(raw).alias(key), F.col(parts).alias(n)), F.col(f"`{col}`").eqNullSafe(F.col(key)), "left")
    rows = rows.withColumn(dealt, F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(n), F.lit(1))).cast("int")).drop(key, n)
    met = rows.join(entries, (F.col(f"`{col}`") == F.col(raw)) & (F.col(dealt) == F.col(part)), "left")
    return met.withColumn(out, found).drop(raw, new, part, dealt)
