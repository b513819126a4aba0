"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, block_ids, counted, id_and_text, mix, ngram_hashes, numbered, stage, sub_batches, tidy, tidy_group, words

_BLOCKS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()),
                     ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_BLOCKS_SQL = "key long, block long, bucket int, grams binary, counts binary, doc_ids array<long>, lengths array<long>"
_JOINED_SQL = "block long, bucket int, payload binary, doc_ids array<long>, lengths array<long>"
#: ``bucket`` of the row that holds the words of a block's texts, compressed: smaller than the numbers of their grams.  Its key is -1 - block.
_FORWARD = -1
#: Bytes of text whose n-grams make a bucket or a shuffle partition: what a task holds of them doesn't grow with the corpus.
BUCKET_BYTES, PARTITION_BYTES = 2 << 20, 4 << 20


def _planes(a: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers as their lowest bytes, then their next ones, ... of ``width`` bytes each."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T


def _from_planes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def _width(a: np.ndarray) -> int:
    return max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1


def _narrow(a: np.ndarray) -> bytes:
    """Small numbers: their width, then their planes, most of which are zeros, compressed."""
    width = _width(a)
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(_planes(a, width).tobytes())


def _widen(b: bytes) -> np.ndarray:
    return _from_planes(zstandard.ZstdDecompressor().decompress(b[1:]), b[0]).astype(np.int64)


def _steps(a: np.ndarray) -> bytes:
    """Steps between sorted hashes: random bytes but for the highest plane, which alone is compressed."""
    width = _width(a)
    planes = _planes(a, width)
    top = zstandard.ZstdCompressor(3).compress(planes[-1].tobytes())
    return bytes([width]) + len(top).to_bytes(4, "little") + top + planes[:-1].tobytes()


def _from_steps(b: bytes) -> np.ndarray:
    end = 5 + int.from_bytes(b[1:5], "little")
    return _from_planes(b[end:] + zstandard.ZstdDecompressor().decompress(b[5:end]), b[0])


def gram_sequence(h: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of all 1-grams, then all 2-grams, ... of a document; two of m distinct n-grams share one with a chance of m / 2**64."""
    return np.concatenate([mix(h), *(ngram_hashes(h, n) for n in range(2, order + 1))])


def _exploded(docs: DataFrame, order: int, n_buckets: int) -> DataFrame:
    """Blocks of documents: a forward row (their texts) and a row for each bucket of their distinct grams."""
    bits = n_buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, blocks, pack = WordHashes(), block_ids(), zstandard.ZstdCompressor(12)
        for batch in batches:
            for part in sub_batches(batch, 1):
                texts = [b" ".join(words(t)) for t in part.column(1).to_pylist()]  # nothing but the words goes on
                grams, counts = counted(np.concatenate([gram_sequence(hashes.of_bytes(t), order) for t in texts]))
                bucket = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(grams) else np.array([], int)
                block = next(blocks)
                rows = [(-1 - block, block, _FORWARD, pack.compress(b"".join(texts)), b"", part.column(0).to_pylist(), [len(t) for t in texts])]
                for a, b in zip(cuts, np.r_[cuts[1:], len(grams)], strict=False):
                    base = np.uint64(int(bucket[a]) << (64 - bits) if bits else 0)
                    rows.append((int(bucket[a]), block, int(bucket[a]), _steps(np.diff(grams[a:b], prepend=base)), _narrow(counts[a:b]), None, None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)

    return docs.mapInArrow(tidy(run), _BLOCKS_SQL)


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """The count table of one bucket, joined to each block's grams of the bucket in their order, what other blocks count; a forward row stays as it is."""
    if pdf["key"].iloc[0] < 0:
        return pdf[["block", "bucket", "grams", "doc_ids", "lengths"]].rename(columns={"grams": "payload"})
    parts = [np.cumsum(_from_steps(g), dtype=np.uint64) for g in pdf["grams"]]
    counts = np.concatenate([_widen(c) for c in pdf["counts"]])
    grams, at, _ = numbered(np.concatenate(parts))
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, at, counts)
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "payload": [_narrow(x) for x in np.split(total[at] - counts, ends)],
                         "doc_ids": None, "lengths": None})


def backoff_log10(rest: np.ndarray, n: int, order: int, alpha: float) -> tuple[float, int]:
    """Sum of the log10 scores of a document's ``n`` words, and how many of them are shares of the corpus.

    ``rest`` are the counts, in all other documents, of its 1-grams, then its 2-grams, ... in their order.
    The latter words' scores are still to be divided by the number of words in all other documents.
    """
    uni = rest[:n].astype(np.float64)
    # a word that no other document has counts as one occurrence, backed off once more
    score, shares = np.where(uni > 0, uni, alpha), np.ones(n, bool)
    begin, below = n, uni
    for k in range(2, order + 1):
        m = n - k + 1
        if m <= 0:
            break
        seen = rest[begin : begin + m].astype(np.float64)
        begin += m
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = seen / below[:m]
        score[k - 1 :] = np.where(seen > 0, direct, alpha * score[k - 1 :])
        shares[k - 1 :] &= seen == 0
        below = seen
    return float(np.log10(score).sum()), int(shares.sum())


def _scorer(order: int, alpha: float):
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["bucket"] == _FORWARD].iloc[0]
        parts = pdf[pdf["bucket"] != _FORWARD].sort_values("bucket")["payload"]
        elsewhere = np.concatenate([_widen(t) for t in parts]) if len(parts) else np.zeros(0, np.int64)
        raw, hashes, at = zstandard.ZstdDecompressor().decompress(row["payload"]), WordHashes(), 0
        docs = []
        for n in map(int, row["lengths"]):
            docs.append(hashes.of_bytes(raw[at : at + n]))
            at += n
        _, number, counts = numbered(np.concatenate([gram_sequence(h, order) for h in docs]))  # as the buckets' rows stand
        total = elsewhere + counts
        own, at, found = np.zeros(len(total), np.int64), 0, []
        for h in docs:
            n = len(h)
            size = sum(max(0, n - k + 1) for k in range(1, order + 1))
            mine = number[at : at + size]
            at += size
            np.add.at(own, mine, 1)
            found.append(backoff_log10(total[mine] - own[mine], n, order, alpha) if n else (0.0, 0))
            own[mine] = 0
        return pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in row["doc_ids"]], "Int64"),
                             "n_tokens": [len(h) for h in docs], "log10": [f[0] for f in found], "shares": [f[1] for f in found]})

    return score


def score_stupid_backoff(docs: DataFrame, *, order: int = 3, alpha: float = 0.4, n_buckets: int | None = None,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole document by a stupid-backoff model counted over all the others.

    Documents are taken in blocks.  Each block explodes into its distinct n-grams of orders 1 to ``order`` with
    counts, dealt by hash into buckets; a bucket holds the count table of its n-grams over the whole corpus
    and joins it to the blocks' n-grams; the block then sums the log scores of each document.  A frequent
    n-gram is one entry a block, never one a row, so no bucket grows with it.  Buckets and shuffle partitions are as many as
    the corpus has BUCKET_BYTES and PARTITION_BYTES of text, so that neither grows with it; ``n_buckets`` (a power of two) may be given.

    The score of a word is count(context, word) / count(context) for the longest context seen elsewhere,
    times ``alpha`` for each order backed off; the document's own counts are taken off; a word that no other
    document has counts ``alpha`` / rest of the corpus.  Returns ``doc_id, n_tokens, lm_log10`` (sum) and
    ``lm_mean``.  A null or empty text has 0 tokens and scores 0.  Ids are integers; a null id stays null.  No
    rows give no rows.
    """
    spark = docs.sparkSession
    src = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 1 << max(0, (n_buckets or -(-size // BUCKET_BYTES)) - 1).bit_length()
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    joined = _exploded(src, order, n_buckets).repartition(n_parts, "key").groupBy("key").applyInPandas(_totals, _JOINED_SQL)
    scored = stage(joined.repartition(n_parts, "block").groupBy("block").applyInPandas(tidy_group(_scorer(order, alpha)), "doc_id long, n_tokens long, log10 double, shares long"), "lm-scores")
    n_tokens = scored.agg(F.sum("n_tokens")).first()[0] or 0
    rest = F.greatest(F.lit(n_tokens) - F.col("n_tokens"), F.lit(1))
    total = F.col("log10") - F.col("shares") * F.log10(rest)
    return scored.select("doc_id", "n_tokens", total.alias("lm_log10"), (total / F.greatest("n_tokens", F.lit(1))).alias("lm_mean"))
