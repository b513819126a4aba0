"""Alignment of two tokenizers' ids over the same bytes, with corpus counts of the id pairs that meet."""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_ids, counted, id_and_text, stage, sub_batches, tidy
from .tokens import ByteEncoder, byte_letters

#: What stands for a blank in a piece.
_BLANK = "▁"
#: Chunks whose alignment a Python worker keeps; it forgets them between blocks once there are more.
MOST_CHUNKS = 150_000


def _unsigned(a: np.ndarray) -> bytes:
    """Numbers that are 0 or more, lowest bytes first plane by plane, compressed."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(planes.tobytes())


def _numbers(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


class Aligned(NamedTuple):
    """The groups of one chunk of text: counts, their text form, and the codes of its distinct links with how often each stands."""

    counts: tuple[int, int, int, int]
    shown: bytes
    links: dict[int, int]


class Aligner:
    """Tokens of tokenizer A over " " + text, of B over text, cut into groups where tokens of both end.

    No piece of B holds a blank after another character and no token of A does, so both end before every single
    blank; a text is cut there and each distinct chunk aligned once.  Texts that can't be cut so are aligned whole.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteEncoder(path_a, plain=True, most_pieces=100_000)
        letters = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        special = {t.content for t in self.a.tokenizer.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * self.a.tokenizer.get_vocab_size()
        for token, i in self.a.tokenizer.get_vocab().items():
            self.bytes_a[i] = token.encode() if token in special else b"".join([letters[c] for c in token])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        #: Whether texts may be cut before blanks: no piece goes on beyond one.
        self.cuts = self.a.cuts and not any(_BLANK in p.lstrip(_BLANK) for p in pieces)
        #: Of each id of A the id of B with the same bytes, -1 if none: the fast path's map.  Byte pieces stand only for what no other piece is.
        same = {x: i for i, x in enumerate(self.bytes_b) if self.b.is_byte(i)}
        same |= {x: i for i, x in enumerate(self.bytes_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.same_list = [same.get(x, -1) if x else -1 for x in self.bytes_a]
        self.same = np.array(self.same_list, np.int64)
        self.pair_shown = [f"{x}|{y}" for x, y in enumerate(self.same_list)]
        self.pair_code = [x * len(pieces) + y for x, y in enumerate(self.same_list)]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.counts, self.codes, self.times, self.ends = array("q"), array("q"), array("q"), array("q")

    def align(self, a: list[int], b: list[int], text: str) -> Aligned | None:
        """Groups of tokens over one text; None if their bytes aren't those of " " + text."""
        raw = b" " + text.encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[x] for x in a]) != raw or b"".join([self.bytes_b[x] for x in b]) != raw:
            return None
        if b == [self.same_list[x] for x in a]:  # only exact one-to-one groups
            n = len(a)
            codes = [self.pair_code[x] for x in a]
            links = dict.fromkeys(codes, 1)
            return Aligned((n, n, n, n), ";".join([self.pair_shown[x] for x in a]).encode(), links if len(links) == n else Counter(codes))
        size_a, size_b, every_b = self.size_a, self.size_b, len(self.size_b)
        groups, links, n_links, i, j = [], {}, 0, 0, 0
        while i < len(a):
            i0, j0, x, y = i, j, a[i], b[j]
            ahead = size_a[x] - size_b[y]
            i, j = i + 1, j + 1
            if not ahead:
                groups.append(f"{x}|{y}")
                code = x * every_b + y
                links[code] = links.get(code, 0) + 1
                n_links += 1
                continue
            while ahead:
                if ahead < 0:
                    ahead += size_a[a[i]]
                    i += 1
                else:
                    ahead -= size_b[b[j]]
                    j += 1
            xs, ys = a[i0:i], b[j0:j]
            groups.append(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}")
            n_links += len(xs) * len(ys)
            often = Counter(ys).items() if len(ys) > 1 else ((ys[0], 1),)
            for x, m in Counter(xs).items() if len(xs) > 1 else ((xs[0], 1),):
                for y, k in often:
                    code = x * every_b + y
                    links[code] = links.get(code, 0) + m * k
        return Aligned((len(a), len(b), len(groups), n_links), ";".join(groups).encode(), links)

    def keep(self, aligned: Aligned) -> int:
        """Room for a chunk's alignment among those of this block; its number."""
        self.shown.append(aligned.shown)
        self.counts.extend(aligned.counts)
        self.codes.extend(aligned.links.keys())
        self.times.extend(aligned.links.values())
        self.ends.append(len(self.codes))
        return len(self.shown) - 1

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that aren't known yet; -1 is the number of one that texts can't be cut at."""
        whole = [c for c in chunks if self.a.whole(c)]
        self.number.update(dict.fromkeys(chunks, -1))
        if not whole:
            return
        for chunk, a, b in zip(whole, self.a.chunk_ids(whole), self.b.encode(whole, num_threads=1), strict=True):
            aligned = self.align(np.frombuffer(a, self.a.dtype).tolist(), b, chunk)
            if aligned:
                self.number[chunk] = self.keep(aligned)

    def whole(self, text: str) -> list[int]:
        """The text as a single chunk; no chunk if it has no tokens."""
        aligned = self.align(self.a.ids(" " + text).tolist(), self.b.encode(text), text)
        return [self.keep(aligned)] if aligned else []

    def block(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """Of each text: its numbers (a row of four counts), the digest of its groups; then ``(text, code, times)`` of all links, ordered."""
        if len(self.number) > MOST_CHUNKS:
            self.forget()
        cut = [t.split(" ") if t and self.cuts else [] for t in texts]
        self.learn(list({c for chunks in cut for c in chunks} - self.number.keys()))
        kept = len(self.shown)  # alignments of whole texts stand after it, and go with the block
        numbers, digests = [], []
        for text, chunks in zip(texts, cut, strict=True):
            k = list(map(self.number.__getitem__, chunks))
            if text and (not k or -1 in k):
                k = self.whole(text)
            numbers.append(np.array(k, np.int64))
            digests.append(hashlib.sha256(b";".join([self.shown[x] for x in k])).hexdigest() if k else "")
        doc = np.repeat(np.arange(len(texts)), [len(k) for k in numbers])
        chunk = np.concatenate([*numbers, np.zeros(0, np.int64)])
        counts = np.array(self.counts).reshape(-1, 4)
        sums = np.zeros((len(texts), 4), np.int64)
        ends = np.cumsum([len(k) for k in numbers])
        for c in range(4):
            sums[:, c] = np.diff(np.r_[0, np.r_[0, np.cumsum(counts[chunk, c])][ends]])
        links = self._links(doc, chunk)
        held = self.ends[kept - 1] if kept else 0
        del self.shown[kept:], self.counts[4 * kept :], self.codes[held:], self.times[held:], self.ends[kept:]
        return sums, digests, links

    def _links(self, doc: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """``(document, code, times)``, one column a distinct pair of a document, ordered."""
        every = max(1, len(self.shown))
        some, often = counted(doc * every + chunk)
        doc, chunk = some // every, some % every
        ends, codes, times = (np.array(x) for x in (self.ends, self.codes, self.times))
        n = np.diff(ends, prepend=0)[chunk]
        row = np.repeat(np.arange(len(chunk)), n)
        place = np.repeat(ends[chunk] - np.cumsum(n), n) + np.arange(len(row))
        key = doc[row] * (len(self.size_a) * len(self.size_b)) + codes[place]
        order = np.argsort(key)
        key, times = key[order], (times[place] * often[row])[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        doc, code = np.divmod(key[first], len(self.size_a) * len(self.size_b))
        return np.stack([doc, code, np.add.reduceat(times, first) if len(first) else first])


@cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
                    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string())),
                    ("codes", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("times", pa.binary())])
_BLOCK_SQL = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
              "codes binary, docs binary, sizes binary, places binary, times binary")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the ids of tokenizers A (a byte-level BPE file) and B (a sentencepiece model) over every whole text.

    Byte offsets where tokens of both end cut the tokens into groups; an A and a B token of one group are linked.  A
    pair's count is the number of documents that hold it linked.  Blocks of documents are aligned once and stored with
    their distinct pairs, so a frequent pair is one entry a block.  Pairs of ids with the same bytes, all that exact
    one-to-one groups have, are counted in vectors of the vocabulary's length; only other pairs enter the pair shuffle.

    Returns one row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  Null and empty
    texts, and texts whose bytes either tokenizer doesn't keep, have zeros and an empty digest.  ``id_col`` must hold
    integers; null and repeated ids are rows like others.  No rows give no rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    src = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    me = Aligner(path_a, path_b)
    same, n_b, n_a = me.same, len(me.size_b), len(me.size_a)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, aligner = block_ids(), aligner_of(path_a, path_b)
        for batch in batches:
            for part in sub_batches(batch, 1, most_rows=1 << 16):
                sums, digests, (doc, code, times) = aligner.block(part.column(1).to_pylist())
                codes, place, held = np.unique(code, return_inverse=True, return_counts=True)
                sizes = np.bincount(doc, minlength=part.num_rows)
                begins = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
                steps = np.where(begins, place, place - np.r_[0, place[:-1]])  # places rise within a document
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for f, v in zip(_BLOCK, (
                    next(ids), part.column(0).to_pylist(), *sums.T.tolist(), digests, _unsigned(np.diff(codes, prepend=0)), _unsigned(held), _unsigned(sizes),
                    _unsigned(steps), _unsigned(times)), strict=True)], schema=_BLOCK)

    blocks = stage(src.mapInArrow(tidy(align), _BLOCK_SQL), "alignment-blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(n_a, np.int64)
        for batch in batches:
            for block, codes, held in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                codes, held = np.cumsum(_numbers(codes)), _numbers(held)
                a = codes // n_b
                exact = same[a] == codes % n_b
                vector[a[exact]] += held[exact]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int((~exact).sum()), block)), pa.array(codes[~exact]), pa.array(held[~exact])], names=["block", "code", "docs"])
        a = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1)), pa.array(a), pa.array(vector[a])], names=["block", "code", "docs"])

    counted = stage(blocks.select("block", "codes", "docs").mapInArrow(tidy(count), "block long, code long, docs long"), "alignment-counts")
    irregular = counted.where("block >= 0")
    pairs = stage(irregular.groupBy("code").agg(F.sum("docs").alias("n")), "alignment-pairs")
    # vectors of the vocabulary of A: its size bounds what the driver gets
    exact, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    for a, n in counted.where("block < 0").groupBy("code").agg(F.sum("docs")).collect():
        exact[a] = n
    for a, n in pairs.groupBy(F.expr(f"code div {n_b}")).agg(F.max("n")).collect():
        best[a] = n
    best = np.maximum(best, exact)
    # the sum of a block's pairs goes back to the block once for all its documents
    back = irregular.join(pairs, "code").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("known"))
    back = back.select("block", F.col("known.n").alias("known"))
    met = blocks.join(back, "block", "left").select(*_BLOCK.names, "known")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {f: batch.column(i)[k].as_py() for i, f in enumerate((*_BLOCK.names, "known"))}
                codes, sizes, steps, times = (np.cumsum(_numbers(row["codes"])), *(_numbers(row[c]) for c in ("sizes", "places", "times")))
                a = codes // n_b
                n = np.where(same[a] == codes % n_b, exact[a], 0)
                n[same[a] != codes % n_b] = row["known"] or []
                ends = np.cumsum(sizes)
                upto = np.r_[0, np.cumsum(steps)]
                place = upto[1:] - np.repeat(upto[ends - sizes], sizes)
                links = np.stack([np.where(n == best[a], 1, 0)[place] * times, n[place] * times])
                total = np.diff(np.c_[np.zeros(2, np.int64), np.c_[np.zeros(2, np.int64), np.cumsum(links, axis=1)][:, ends]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, total),
                     pa.array(row["groups_sha256"], pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return met.mapInArrow(tidy(score), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
