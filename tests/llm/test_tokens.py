"""The token store and the alignment of two tokenizers against the libraries' own encoding of whole texts, and the perfect hash."""

import bisect
import hashlib
import struct
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from molspark.llm import perfect_hash, token_alignment, token_store
from molspark.llm.queries import tokenizer_path
from molspark.llm.tokens import ByteEncoder, byte_letters

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n b\tc\r\n", "don't won't I'm we've 'tis 'S", "x" * 3000, "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ a▁b ▁▁",
       "naïve Ünïcode ÿ ×÷", "日本語 テスト 한국어", "emoji 😀 👩‍👩‍👧 z", "a\x00b", "a\x0b\x0c\x1c\x1d\x85\xa0 　b", "1234567 3.14 ²½Ⅷ", "é ​ ﻿", "tab\tafter tab", "'s", " 's 't"]
SCHEMA = "doc_id long, text string, h string, block long, shard int, key string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, 2, "y") for i, t in enumerate(ODD)] + [(3, "a", None, None, None, None), (3, "a", None, None, None, None), (None, "null id", *[None] * 4), (None, None, *[None] * 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_ids(plain):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = plain
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("plain", [False, True])
def test_encoder_equals_the_tokenizer(spark, plain):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoder, whole = ByteEncoder(A, plain, most_pieces=500), plain_ids(plain)
    for _ in range(2):
        for i in range(0, len(texts), 7):
            for text, ids in zip(texts[i : i + 7], encoder.encode_all(texts[i : i + 7]), strict=True):
                assert np.frombuffer(ids, encoder.dtype).tolist() == whole(text)
    chunks = ["a", "don't", "x\ny", "日本", "é."]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.chunk_ids(chunks)] == [whole(" " + c) for c in chunks]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    sizes, bits, ranks, slots = perfect_hash.build(h1, h2)
    assert sorted(slots.tolist()) == list(range(n))
    assert perfect_hash.find(h1, h2, sizes, lambda at: bits[at], lambda at: ranks[at]).tolist() == slots.tolist()
    if n > 1:
        assert 64 * len(bits) < 6 * n + 5000
        with pytest.raises(ValueError):
            perfect_hash.build(h1[[0, 0]], h2[[0, 0]])


def rows_of(spark, docs, tmp_path, **options):
    store = token_store.write_token_store(docs, A, str(tmp_path / "store"), **options)
    return store, token_store.read_token_store(spark, store, docs).collect()


@pytest.mark.parametrize("shard_bytes", [64 << 20, 200])
def test_token_store_of_odd_rows(spark, odd, tmp_path, shard_bytes):
    """Repeated and null ids have all their documents, over several shards too; get() reads them without Spark."""
    store, got = rows_of(spark, odd, tmp_path, shard_bytes=shard_bytes)
    whole = plain_ids(False)
    want = Counter()
    for r in odd.collect():
        ids = [*whole(r.text), 0]
        want[r.doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # ids ascend, starts have no gap
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    for key in (None, 3, 7, 12):
        texts = [r.text for r in odd.collect() if r.doc_id == key]
        assert sorted(map(tuple, store.get(key))) == sorted((*whole(t), 0) for t in texts)
    assert store.get(10**9) == [] and store.get("no key") == []
    absent = spark.createDataFrame([(5,), (5,), (777,)], "doc_id long")
    assert [r.doc_id for r in token_store.read_token_store(spark, store, absent).collect()] == [5]


def test_token_store_of_documents_and_of_none(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, got = rows_of(spark, docs, tmp_path)
    whole, at = plain_ids(False), 0
    for d, r in zip(docs.orderBy("doc_id").collect(), sorted(got, key=lambda r: r.doc_id), strict=True):
        ids = [*whole(d.text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    store, none = rows_of(spark, odd.limit(0), tmp_path / "none")
    assert none == [] and store.get(1) == []


def test_hashes_without_spark(spark):
    keys = [None, "", "0", "12345678", "a longer key that has more than thirty-two bytes in it", "é日本"]
    h1, h2 = token_store.key_hashes(F.col("k"))
    for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", h1.alias("a"), h2.alias("b")).collect():
        assert token_store.hashes_of(r.k) == (r.a % 2**64, r.b % 2**64)


def aligned_plainly(rows):
    """The contract by its words: each text encoded whole, each pair of occurrences told."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(byte_letters())}
    of_a = {i: token.encode() if i == 50256 else bytes(letters[c] for c in token) for token, i in t.get_vocab().items()}
    of_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())]
    found, docs_of = [], Counter()
    for doc, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(of_a[i] for i in a) != raw or b"".join(of_b[i] for i in b) != raw:
            found.append((doc, [], [], [], Counter()))
            continue
        ends_a, ends_b = (list(accumulate(len(of[i]) for i in ids)) for of, ids in ((of_a, a), (of_b, b)))
        groups, links, i, j = [], Counter(), 0, 0
        for cut in sorted({*ends_a} & {*ends_b}):
            i2, j2 = bisect.bisect_right(ends_a, cut), bisect.bisect_right(ends_b, cut)
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.update((x, y) for x in a[i:i2] for y in b[j:j2])
            i, j = i2, j2
        docs_of.update(links.keys())
        found.append((doc, a, b, groups, links))
    best = Counter()
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    return Counter((doc, len(a), len(b), len(groups), sum(links.values()), sum(m for k, m in links.items() if docs_of[k] == best[k[0]]),
                    sum(m * docs_of[k] for k, m in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, a, b, groups, links in found)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most_chunks", [400_000, 20])
def test_alignment(spark, odd, monkeypatch, most_chunks):
    monkeypatch.setattr(token_alignment, "MOST_CHUNKS", most_chunks)
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)).repartition(5)
    got = Counter(tuple(r) for r in token_alignment.align_tokenizers(docs, A, B).select(COLUMNS).collect())
    assert got == aligned_plainly([(r.doc_id, r.text) for r in docs.collect()])
    assert token_alignment.align_tokenizers(odd.limit(0), A, B).count() == 0


def test_long_group_is_counted_not_listed():
    """Two streams of tokens that never end together but at the end: every pair of occurrences counts."""
    aligner = token_alignment.Aligner(A, B)
    aligner.bytes_a, aligner.size_a = [b" x", b"yx"], [2, 2]
    aligner.bytes_b, aligner.size_b = [b" ", b"xy", b"x"], [1, 2, 1]
    n = 50_000
    found = aligner.align([0, *[1] * n], [0, *[1] * n, 2], "x" + "yx" * n)
    assert found.counts == (n + 1, n + 2, 1, (n + 1) * (n + 2)) and found.links[1 * 3 + 1] == n * n
