"""Spelling variants against a plain search, with buckets split to the last letter, and on odd rows."""

import re
import zlib
from collections import Counter

import pytest

from molspark.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(rows, typo_every=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    out, form = {}, {}
    for w in n:
        others = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
        out[w] = len(others)
    found = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        found.add((w, form.get(w), root, n[w], out[w], n.get(form.get(w))))
    return found


WORDS = ["abcdefg", "abcdefgh", "abcdeffg", "xabcdefg", "bcdefgh", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aabaaaa", "ÀÉÎõöÿ×", "àéîõöÿ÷", "àéîõöÿ", "éàéîõöÿ÷", "z" * 500, "z" * 501, "z" * 250 + "y" + "z" * 250]
ROWS = [(i, f"{w} {w}, {w}-{w}1{w}") for i, w in enumerate(WORDS)] + [(100, "abcdefg " * 80), (101, "abcdeffg " * 9), (102, None), (103, ""), (None, "abcdefg abcdefg aaaaaaa"), (104, "abcdefg abcdefg"), (104, "abcdefg abcdefg"),
        (105, "aaaaaaaa " * 800), (106, "naïve日本naïvete ﬁnances İstanbul straße")]


@pytest.mark.parametrize("bucket", [8192, 2])
def test_group_spellings(spark, monkeypatch, bucket):
    """Whole, and with every bucket split until one letter is left."""
    monkeypatch.setattr(spelling, "BUCKET_WORDS", bucket)
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in ROWS], "doc_id long, text string, word string, n long, key long").repartition(3)
    got = [tuple(r) for r in spelling.group_spellings(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plainly(ROWS)
    assert spelling.group_spellings(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    """Counts that rise tenfold at each step: the root is the last."""
    steps = ["abcdefghijk"[: 7 + i] for i in range(4)]
    docs = spark.createDataFrame([(i, f"{w} " * (2 * 10**i)) for i, w in enumerate(steps)], "doc_id long, text string")
    got = {r.word: r for r in spelling.group_spellings(docs, typo_every=0).collect()}
    assert [got[w].root for w in steps] == [steps[-1]] * 4 and [got[w].form for w in steps] == [*steps[1:], None]


def test_index_against_plain_search():
    words = sorted({"".join("abc"[(i // 3**k) % 3] for k in range(7 + i % 2)) for i in range(0, 4000, 3)})
    index = spelling.PositionIndex(words)
    for w in words[::7]:
        found = {words[k] for k in index.members(index.near(w, (1 << len(words)) - 1))}
        assert found == {v for v in words if v != w and near(v, w)}
