"""Token ids as raw binary shards, with a minimal perfect hash index for constant-time access by document key.

A store is a folder:

* ``ids/<shard>-<attempt>.ids``: the ids of the shard's documents, end ids included, one after the other, little-endian, of 2 or 4 bytes each;
* ``ids/<shard>-<attempt>.offsets``: where in the shard each document begins, and the shard's number of ids: 64-bit each;
* ``index/<bucket>-<attempt>.mph``: of the keys of one bucket, the minimal perfect hash and a record a key at its slot;
* ``shards``, ``buckets``: Parquet tables that name the files of the attempts that were committed.

Documents stand in ascending order of their ids over all shards.  A record holds a fingerprint of the key, its first
document's shard, number, offset and length, and its last document's shard and number: those between have the key too.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import session_folder
from .common import id_and_text, stage, sub_batches, tidy, tidy_group
from .perfect_hash import build, find
from .tokens import byte_encoder

#: Ids in the buffer of a task that reads a shard.
BUFFER = 1 << 21
#: A bucket of the index has some 2**20 keys; small stores get up to 256 buckets of 1024 keys or more, so that many tasks share the work.
BUCKET_KEYS, FEW_BUCKETS, SMALL_BUCKET_KEYS = 1 << 20, 256, 1 << 10
#: Most shards: beyond, they grow, which costs no memory.
MOST_SHARDS = 50_000

_RECORD = np.dtype([("fingerprint", "<u8"), ("offset", "<u8"), ("n_tokens", "<u8"), ("shard", "<u4"), ("number", "<u4"), ("last_shard", "<u4"), ("last_number", "<u4")])
_MAGIC = b"MPH1"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that driver and executors share, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key's text: the first deals keys to buckets, the second is the fingerprint."""
    text = key.cast("string")
    return F.xxhash64(text), F.xxhash64(F.concat(F.lit("~"), text))


def hashes_of(key: object) -> tuple[int, int]:
    """``key_hashes`` of one key, without Spark, modulo 2**64."""
    import xxhash

    if key is None:
        return 42, 42
    text = str(key).encode()
    return xxhash.xxh64_intdigest(text, 42), xxhash.xxh64_intdigest(b"~" + text, 42)


class KeyIndex:
    """One index file; of a key it reads a few words, whether the file is held in memory (``whole``) or not."""

    def __init__(self, path: str, whole: bool):
        system, at = file_system(path)
        self.file = pa.BufferReader(system.open_input_stream(at).read()) if whole else system.open_input_file(at)
        head = np.frombuffer(self._at(4, 24), "<u8")
        if self._at(0, 4) != _MAGIC:
            raise ValueError(f"{path} is no index file")
        self.n, n_levels, n_words = map(int, head)
        self.sizes = np.frombuffer(self._at(28, 8 * n_levels), "<u8")
        self.words_at = 28 + 8 * n_levels
        self.ranks_at = self.words_at + 8 * n_words
        self.records_at = self.ranks_at + 8 * (n_words // 8)
        self.arrays = None
        if whole:
            raw = self._at(0, self.records_at + _RECORD.itemsize * self.n)
            self.arrays = (np.frombuffer(raw, "<u8", n_words, self.words_at), np.frombuffer(raw, "<u8", n_words // 8, self.ranks_at),
                           np.frombuffer(raw, _RECORD, self.n, self.records_at))

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _values(self, which: int, start: int, dtype: np.dtype, at: np.ndarray) -> np.ndarray:
        if self.arrays:
            return self.arrays[which][at]
        size = np.dtype(dtype).itemsize
        return np.frombuffer(b"".join(self._at(start + size * k, size) for k in at.tolist()), dtype)

    def records(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the index, and the records of those."""
        slot = find(h1, h2, self.sizes, lambda at: self._values(0, self.words_at, "<u8", at), lambda at: self._values(1, self.ranks_at, "<u8", at))
        there = np.flatnonzero(slot >= 0)
        record = self._values(2, self.records_at, _RECORD, slot[there])
        same = record["fingerprint"] == h2[there]
        return there[same], record[same]


def _write_index(path: str, h1: np.ndarray, h2: np.ndarray, records: np.ndarray) -> None:
    sizes, bits, ranks, slots = build(h1, h2)
    placed = np.zeros(len(records), _RECORD)
    placed[slots] = records
    system, at = file_system(path)
    with system.open_output_stream(at) as f:
        for part in (_MAGIC, np.array([len(records), len(sizes), len(bits)], "<u8"), sizes, bits, ranks, placed):
            f.write(part if isinstance(part, bytes) else part.tobytes())


@dataclass(frozen=True)
class TokenStore:
    """A written store; ``get`` needs no Spark."""

    path: str
    width: int

    def _table(self, name: str) -> pd.DataFrame:
        system, at = file_system(f"{self.path}/{name}")
        return pq.read_table(at, filesystem=system).to_pandas()

    @cached_property
    def _buckets(self) -> dict[int, str]:
        t = self._table("buckets")
        return dict(zip(t["bucket"].tolist(), t["file"], strict=True))

    @cached_property
    def _shards(self) -> dict[int, str]:
        t = self._table("shards")
        return dict(zip(t["shard"].tolist(), t["file"], strict=True))

    @cached_property
    def _n_buckets(self) -> int:
        return int(self._table("buckets")["n_buckets"].max()) if self._buckets else 0

    def get(self, key: object) -> list[np.ndarray]:
        """The ids of each document under a key, none if there is none: a few small reads, whatever the store's size."""
        if not self._buckets:
            return []
        h1, h2 = hashes_of(key)
        bucket = (h1 >> 33) % self._n_buckets
        if bucket not in self._buckets:
            return []
        there, records = KeyIndex(f"{self.path}/index/{self._buckets[bucket]}", whole=False).records(np.array([h1], np.uint64), np.array([h2], np.uint64))
        if not len(there):
            return []
        r, out = records[0], []
        for shard in range(int(r["shard"]), int(r["last_shard"]) + 1):
            if shard not in self._shards:  # no document fell to it
                continue
            reader = ShardReader(f"{self.path}/ids/{self._shards[shard]}", self.width)
            last = int(r["last_number"]) + 1 if shard == r["last_shard"] else reader.n_docs
            for number in range(int(r["number"]) if shard == r["shard"] else 0, last):
                begin, end = reader.span(number)
                out.append(np.concatenate([*reader.ids(begin, end), np.zeros(0, f"<u{self.width}")]))
        return out


class ShardReader:
    """Random access to one shard's documents; neighbours come from one buffer."""

    def __init__(self, path: str, width: int):
        system, at = file_system(path)
        self.file, self.width = system.open_input_file(f"{at}.ids"), width
        self.offsets = system.open_input_file(f"{at}.offsets")
        self.n_docs = self.offsets.size() // 8 - 1
        self.held_at, self.held = 0, np.zeros(0, f"<u{width}")
        self.known_at, self.known = 0, np.zeros(0, "<u8")

    def span(self, number: int) -> tuple[int, int]:
        if not self.known_at <= number < self.known_at + len(self.known) - 1:
            self.offsets.seek(8 * number)
            self.known_at, self.known = number, np.frombuffer(self.offsets.read(8 * 4097), "<u8")
        k = number - self.known_at
        return int(self.known[k]), int(self.known[k + 1])

    def ids(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """Ids ``begin`` .. ``end`` of the shard, in parts of BUFFER at most."""
        while begin < end:
            if not self.held_at <= begin < self.held_at + len(self.held):
                self.file.seek(begin * self.width)
                self.held_at, self.held = begin, np.frombuffer(self.file.read(BUFFER * self.width), self.held.dtype)
            part = self.held[begin - self.held_at : end - self.held_at]
            yield part
            begin += len(part)


_ENTRY = "shard int, file string, number long, offset long, n_tokens long"


def write_token_store(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int = 0, shard_bytes: int = 64 << 20,
                      id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode all texts, write their ids in ascending order of the documents' ids, and index them.

    ``path`` is a folder that driver and executors share; if none is given, one in the session's shared folder.  Each
    document is its ids by the tokenizers file and ``end_id``.  Shards hold some ``shard_bytes`` of text (each row
    counts 16 bytes more), at most MOST_SHARDS are made.  A null or empty text is ``end_id`` alone.  Rows with one id,
    null included (it comes first), each have a document, in the order of their texts' hashes; they may reach over
    several shards, and ``get`` gives all of them.  No rows give a store without shards.  Other columns aren't read.

    A task that is run again writes files of its own; the tables name those of the committed attempt.
    """
    spark = docs.sparkSession
    path = path or f"{session_folder(spark)}/tokens-{uuid.uuid4().hex}"
    system, at = file_system(path)
    for folder in ("ids", "index"):
        system.create_dir(f"{at}/{folder}", recursive=True)
    src = id_and_text(docs, id_col, text_col)
    size = src.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    shards = min(MOST_SHARDS, max(1, size // shard_bytes, min(size >> 20, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    kind = src.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, name = task.partitionId(), f"{task.partitionId():08d}-{task.taskAttemptId()}"
        encoder = byte_encoder(tokenizer)
        tail = np.array([end_id], encoder.dtype).tobytes()
        files, at_id, number = [], 0, 0
        system, folder = file_system(path)
        for batch in batches:
            if batch.num_rows and not files:
                files = [system.open_output_stream(f"{folder}/ids/{name}.{end}") for end in ("ids", "offsets")]
            lengths = []
            for part in sub_batches(batch, 1, 2 << 20):
                held = [ids + tail for ids in encoder.encode_all(part.column(1).to_pylist())]
                files[0].write(b"".join(held))
                lengths += [len(ids) // encoder.width for ids in held]
            lengths = np.array(lengths, np.int64)
            offsets = at_id + np.r_[0, np.cumsum(lengths)].astype("<u8")
            if files:
                files[1].write(offsets[:-1].tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, shard, np.int32)), pa.array([name] * n, pa.string()), pa.array(np.arange(number, number + n)),
                 pa.array(offsets[:-1].astype(np.int64)), pa.array(lengths)], names=["doc_id", "shard", "file", "number", "offset", "n_tokens"])
            at_id, number = int(offsets[-1]), number + n
        if files:
            files[1].write(np.array([at_id], "<u8").tobytes())
        for f in files:
            f.close()

    ordered = src.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    entries = stage(ordered.mapInArrow(tidy(write), f"doc_id {kind}, {_ENTRY}"), "token-entries")
    totals = entries.groupBy("shard", "file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a shard
    totals.withColumn("base", base).coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")
    n = entries.count()
    buckets = max(-(-n // BUCKET_KEYS), min(FEW_BUCKETS, -(-n // SMALL_BUCKET_KEYS)), 1)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyspark import TaskContext

        bucket = int(pdf["bucket"].iloc[0])
        name = f"{bucket:08d}-{TaskContext.get().taskAttemptId()}.mph"
        records = np.zeros(len(pdf), _RECORD)
        h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        records["fingerprint"] = h2
        for c in _RECORD.names[1:]:
            records[c] = pdf[c].to_numpy()
        _write_index(f"{path}/index/{name}", h1, h2, records)
        return pd.DataFrame({"bucket": [bucket], "file": [name], "n_keys": [len(pdf)], "n_buckets": [buckets]})

    keys = entries.groupBy("doc_id").agg(F.min(F.struct("shard", "number", "offset", "n_tokens")).alias("a"), F.max(F.struct("shard", "number")).alias("z"))
    h1, h2 = key_hashes(F.col("doc_id"))
    keys = keys.select(h1.alias("h1"), h2.alias("h2"), "a.*", F.col("z.shard").alias("last_shard"), F.col("z.number").alias("last_number")).withColumn("bucket", _bucket(buckets))
    done = keys.groupBy("bucket").applyInPandas(tidy_group(index), "bucket int, file string, n_keys long, n_buckets long")
    done.write.mode("overwrite").parquet(f"{path}/buckets")
    return TokenStore(path, byte_encoder(tokenizer).width)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned("h1", 33), F.lit(buckets)).cast("int")


def read_token_store(spark: SparkSession, store: TokenStore, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document under the keys, read back from the store's files.

    Keys are looked up bucket by bucket in the index, then documents are read shard by shard in the order of the
    files.  A key that isn't in the store gives no row; a repeated one counts once.  ``start``: ids of all documents before it.
    """
    path, width = store.path, store.width
    buckets, shards = spark.read.parquet(f"{path}/buckets"), spark.read.parquet(f"{path}/shards")
    n_buckets = buckets.agg(F.max("n_buckets")).first()[0] or 1
    kind = keys.schema[key_col].dataType.simpleString()
    h1, h2 = key_hashes(F.col("doc_id"))
    wanted = keys.select(F.col(f"`{key_col}`").alias("doc_id")).distinct().select("doc_id", h1.alias("h1"), h2.alias("h2")).withColumn("bucket", _bucket(n_buckets))
    wanted = wanted.join(buckets.select("bucket", "file"), "bucket").repartition("bucket").sortWithinPartitions("bucket").select("doc_id", "h1", "h2", "file")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            names = batch.column(3).to_pylist()
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in (1, 2))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != held:
                    held, index = names[a], KeyIndex(f"{path}/index/{names[a]}", whole=True)
                there, r = index.records(h1[a:b], h2[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(there + a)), *(pa.array(r[c].astype(np.int64)) for c in ("shard", "number", "last_shard", "last_number"))],
                    names=["doc_id", "first", "number", "last", "last_number"])

    found = wanted.mapInArrow(tidy(look_up), f"doc_id {kind}, first long, number long, last long, last_number long")
    runs = found.withColumn("shard", F.explode(F.sequence("first", "last"))).join(shards.withColumn("shard", F.col("shard").cast("long")), "shard").select(
        "doc_id", "shard", "file", "base", F.expr("if(shard = first, number, 0)").alias("from"), F.expr("if(shard = last, last_number + 1, n_docs)").alias("upto"))
    runs = stage(runs, "token-runs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader = None, None
        for batch in batches:
            rows, start, n_tokens, crcs = [], [], [], []
            for i, (name, base, first, upto) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "base", "from", "upto")), strict=True)):
                if name != held:
                    held, reader = name, ShardReader(f"{path}/ids/{name}", width)
                for number in range(first, upto):
                    begin, end = reader.span(number)
                    crc = 0
                    for part in reader.ids(begin, end):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    rows.append(i)
                    start.append(base + begin)
                    n_tokens.append(end - begin)
                    crcs.append(crc)
                    if len(rows) == 4096:
                        yield _found(batch, rows, start, n_tokens, crcs)
                        rows, start, n_tokens, crcs = [], [], [], []
            yield _found(batch, rows, start, n_tokens, crcs)

    return runs.repartitionByRange("shard", "from").sortWithinPartitions("shard", "from").mapInArrow(tidy(read), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _found(batch: pa.RecordBatch, rows: list[int], start: list[int], n_tokens: list[int], crcs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, n_tokens, crcs))],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])
