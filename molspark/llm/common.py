"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Writes a table in the shared folder that the session names and reads it back: what follows survives lost executors.
stage = materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and Python; a single longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand Python batches of BATCH_BYTES, so that memory off the heap doesn't follow the texts' lengths."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _give_back() -> None:
    """Return what this Python process no longer uses to the machine; its memory counts as the executor's, and workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc, nothing to trim
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives memory back when a task ends."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return tidied


def tidy_group(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``f`` for ``applyInPandas``, which gives memory back after each group; for groups of megabytes."""
    def tidied(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        _give_back()
        return out

    return tidied


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator needs, under fixed names; other columns are not read."""
    return small_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


#: A key with more than one in HOT of all rows is hot; there are fewer than HOT of them, whatever the input.
HOT = 1024


def join_unique(rows: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``right``, which has one row a ``key`` and in ``size`` how many of the ``total`` rows have that key.

    Rows of hot keys meet theirs by a broadcast (fewer than HOT rows) where they stand; the others are shuffled, so no task gets
    more than one in HOT of all rows for one key.  ``how``: inner, or left for all rows.  ``rows`` and ``right`` are read twice: store them first.
    """
    hot, cold = right.where(F.col(size) * HOT > total), right.where(F.col(size) * HOT <= total)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return met.unionByName(rest.join(cold, key, how))


#: Bits of the filter of ``apart`` for each key, and the most: 64 MB.  Beyond some 10**8 keys more rows are joined that need not be.
BITS_A_KEY, MOST_BITS = 16, 1 << 29


def bit_maps(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """``__map_no, __map``: bitmaps of the hashes of ``key``, bits / 32768 rows of 4 KB at most."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits)) + 1  # Spark's bitmaps number values from 1
    return keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__map_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__map"))


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores behind those that ``df`` has already, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def apart(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose key is surely not among ``keys``, and the rest, for an exact join.

    A filter of BITS_A_KEY bits a key, MOST_BITS at most, is broadcast, so the first part, most rows where few keys are listed, is never shuffled.
    What falls into the rest by chance changes nothing in the result of what follows.
    """
    n = keys.count()
    bits = min(MOST_BITS, 1 << max(20, (BITS_A_KEY * n - 1).bit_length()))
    maps = stage(bit_maps(keys, keys_key, bits), "filter")
    cols = df.columns
    bit, no, at, map_no, bitmap = free(df, "__bit", "__no", "__at", "__map_no", "__map")
    maps = maps.select(F.col("__map_no").alias(map_no), F.col("__map").alias(bitmap))
    marked = df.withColumn(bit, F.pmod(F.xxhash64(key), F.lit(bits)) + 1).withColumns({no: F.bitmap_bucket_number(bit), at: F.bitmap_bit_position(bit)})
    marked = marked.join(F.broadcast(maps), F.col(no) == F.col(map_no), "left")
    hit = F.expr(f"coalesce(shiftright(cast(conv(hex(substring({bitmap}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) & 1, 0) = 1")
    return marked.where(~hit).select(*(F.col(f"`{c}`") for c in cols)), marked.where(hit).select(*(F.col(f"`{c}`") for c in cols))


def _word_bytes() -> bytes:
    out = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(out)


#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
WORD_BYTES = _word_bytes()


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything at ``most`` words, so its memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        return self.of_bytes(text.encode("utf-8", "surrogatepass") if text else b"")

    def of_bytes(self, raw: bytes) -> np.ndarray:
        w = raw.translate(WORD_BYTES).split()
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX[1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[2]
        return h ^ (h >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position of a sequence of word hashes."""
    if len(h) < n:
        return h[:0]
    with np.errstate(over="ignore"):
        out = mix(h[: len(h) - n + 1] + np.uint64(n))
        for i in range(1, n):
            out = mix(out * _MIX[0] + h[i : len(h) - n + 1 + i])
    return out


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the number of each value among them, and how often each stands."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(values) else np.zeros(0, bool)
    number = np.empty(len(values), np.int32 if len(values) < 1 << 31 else np.int64)
    number[order] = np.cumsum(new, dtype=number.dtype) - 1
    first = np.flatnonzero(new)
    return ordered[first], number, np.diff(np.r_[first, len(values)])


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each stands; ``values`` are sorted in place."""
    values.sort()
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


def sub_batches(batch, column: int, most_bytes: int = 8 << 20, most_rows: int = 4096):
    """Slices of an Arrow batch of at most ``most_rows`` rows and, but for a single longer one, ``most_bytes`` of text."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast("int64"))
    first, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and (held + n > most_bytes or i - first == most_rows):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def block_ids():
    """Numbers for the blocks of this task, apart from those of other tasks."""
    from itertools import count

    from pyspark import TaskContext

    return count(TaskContext.get().partitionId() << 32)
