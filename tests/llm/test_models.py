"""Fingerprints, packing and the weak-label model against second implementations, and the pipeline on odd inputs."""

import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from molspark.llm import media, packing, quality
from molspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(samples):
    """Peaks and pairs by loops over frames, bands and bins of a plain transform of each frame."""
    x = [s - 128.0 for s in samples]
    n = max(1, -(-(len(x) - 256) // 128) + 1)
    peaks = []
    for f in range(n):
        frame = np.array((x[f * 128 : f * 128 + 256] + [0.0] * 256)[:256], np.float32) * np.hanning(256).astype(np.float32)
        z = np.fft.rfft(frame)
        p = (z.real**2 + z.imag**2).astype(np.float32)
        row = []
        for a, b in media.BANDS:
            best, top = 0, np.float32(0)
            for k in range(max(a, 1), min(b, 128)):
                if p[k] > p[k - 1] and p[k] >= p[k + 1] and p[k] > top:
                    best, top = k, p[k]
            row.append((best, top))
        peaks.append(row)
    pairs = []
    for f in range(n):
        for gap in range(1, media.FAN + 1):
            if f + gap < n:
                other = max(range(4), key=lambda k: (peaks[f + gap][k][1], -k))
                target = peaks[f + gap][other][0]
                pairs += [(f, b << 10 | target << 2 | gap) for b, _ in peaks[f] if b and target]
    return sorted(pairs)


@pytest.mark.parametrize("at_once", [4096, 16, 1])
def test_fingerprints_over_several_runs(spark, monkeypatch, at_once):
    """Runs of frames, however short, give what a single one gives, and what the query returns."""
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    for samples in (rng.integers(0, 256, 9000), rng.integers(97, 123, 6400), np.full(700, 128), np.zeros(64, int), np.arange(5000) % 256):
        t, c = media.fingerprint(samples.astype(np.uint8))
        assert list(zip(t.tolist(), c.tolist(), strict=True)) == plain_fingerprint(samples.tolist())


def test_stored_media_and_arrays_of_the_query(spark):
    docs = spark.createDataFrame([(1, "some text that is long enough for a few frames " * 30), (2, None), (None, "x")], "doc_id long, text string")
    for r in media.wav_media(docs).collect():
        samples = list(media.from_wav(r.media))
        assert list(zip(r.pair_time, r.pair_code, strict=True)) == plain_fingerprint(samples) and r.n_pairs == len(r.pair_time)


def test_padding_is_little(spark):
    """Every sequence but one a group is more than half full, and padding is a small share of all tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(6)
    pieces = packing.pack(docs, tokenizer_path()).collect()
    used = Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    tokens = sum(used.values())
    assert max(used.values()) <= 4096 and sum(2 * u <= 4096 for u in used.values()) <= 1
    assert len(used) * 4096 <= 1.02 * tokens + 4096 and len(used) >= -(-tokens // 4096)


def test_another_tokenizers_file_is_handed_whole_texts(tmp_path):
    """A file that splits or lower-cases otherwise gives the ids that the tokenizer itself gives."""
    from tokenizers import Tokenizer

    made = json.load(open(tokenizer_path(), encoding="utf-8"))
    made["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    e, plain = packing.WordEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not e.fast and packing.WordEncoder(tokenizer_path()).fast
    for text in ("Hello World  ABC", "don\'t é"):
        assert e.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_label_model_against_plain_loops():
    """EM over made-up votes: posteriors by dictionaries and loops; and the true classes are found."""
    rng = np.random.default_rng(7)
    m = len(quality.LABELLERS)
    right = rng.uniform(0.7, 0.95, m)
    truth, patterns = {}, Counter()
    for _ in range(3000):
        good = rng.random() < 0.8
        votes = "".join("0" if rng.random() < 0.3 else "+" if (rng.random() < right[k]) == good else "-" for k in range(m))
        patterns[votes] += 1
        truth.setdefault(votes, Counter())[good] += 1
    model = quality.fit_label_model(dict(patterns))
    post = {}
    for v in patterns:
        good, bad = v.count("+"), v.count("-")
        post[v] = 0.02 if bad >= 2 else 0.3 if bad == 1 else (good + 1) / (good + bad + 1.2)
    for _ in range(60):
        total = sum(patterns.values())
        prior = min(max(sum(n * post[v] for v, n in patterns.items()) / total, 1e-3), 1 - 1e-3)
        chance = {}
        for k in range(m):
            for c in (0, 1):
                w = {s: 1.0 + sum(n * (post[v] if c == 0 else 1 - post[v]) for v, n in patterns.items() if v[k] == s) for s in "+-"}
                for s in "+-":
                    chance[k, c, s] = w[s] / sum(w.values())
        for v in patterns:
            log = [math.log(prior if c == 0 else 1 - prior) + sum(math.log(chance[k, c, s]) for k, s in enumerate(v) if s != "0") for c in (0, 1)]
            post[v] = 1 / (1 + math.exp(min(50, max(-50, log[1] - log[0]))))
    got = dict(zip(patterns, model.posterior(list(patterns)), strict=True))
    assert all(abs(got[v] - post[v]) < 1e-6 for v in patterns)
    assert sum(c[got[v] >= 0.5] for v, c in truth.items()) >= 0.9 * sum(patterns.values())


def plain_features(text, dims):
    """Weights of a text by the definition: collapsed shapes, their pairs, and the statistics' bins."""
    shapes = []
    for word in text.split():
        shape = ""
        for ch in word.encode():
            c = chr(ch)
            s = "a" if ch >= 128 or c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
            shape += s if not shape.endswith(s) else ""
        shapes.append(shape)
    out = Counter()
    for key in [f"1{s}" for s in shapes] + [f"2{a} {b}" for a, b in zip(shapes, shapes[1:], strict=False)]:
        out[zlib.crc32(key.encode()) % dims] += 1 / len(shapes)
    out = {k: v**0.5 for k, v in out.items()}
    for name, value in quality.statistics(text).items():
        level = int(math.log2(value + 1)) if name in ("words", "lines") else int(min(value, 1.0) * 20)
        out[zlib.crc32(f"{name}={level}".encode()) % dims] = 1.0
    return out


def test_scorer_against_plain_loops(spark):
    """Features, training and scores by dictionaries; and the scorer learns what the labels say."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and r.text.strip()][:80]
    dims = 1 << 12
    target = [0.9 if len(t) % 2 else 0.1 for t in docs]
    rows = [quality.hashed_features(quality.shapes_of(t), quality.statistics(t), dims) for t in docs]
    for t, (at, x) in zip(docs, rows, strict=True):
        want = plain_features(t, dims)
        assert set(at.tolist()) == set(want) and all(abs(want[k] - v) < 1e-9 for k, v in zip(at.tolist(), x.tolist(), strict=True))
    w, b = quality._train(rows, np.array(target), dims, epochs=5)
    weight, bias, square, square_bias = {}, 0.0, {}, 1e-2
    for _ in range(5):
        for t, y in zip(docs, target, strict=True):
            x = plain_features(t, dims)
            g = 1 / (1 + math.exp(-(sum(weight.get(k, 0.0) * v for k, v in x.items()) + bias))) - y
            for k, v in x.items():
                d = g * v + 1e-4 * weight.get(k, 0.0)
                square[k] = square.get(k, 1e-2) + d * d
                weight[k] = weight.get(k, 0.0) - 0.3 * d / square[k] ** 0.5
            square_bias += g * g
            bias -= 0.3 * g / square_bias**0.5
    assert abs(b - bias) < 1e-6 and all(abs(w[k] - v) < 1e-6 for k, v in weight.items())
    model = quality.QualityModel(quality.fit_label_model({}), w, b)
    assert all(abs(model.score(t)[0] - 1 / (1 + math.exp(-sum(weight.get(k, 0.0) * v for k, v in plain_features(t, dims).items()) - bias))) < 1e-6 for t in docs)


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"Word{i} and the of it. " * 400) for i in range(40)], "doc_id long, text string")
    assert quality.fit_quality(docs, sample_bytes=60_000).bias != 0 and quality.fit_quality(docs, sample_bytes=10).bias == 0


def test_pipeline_on_empty_repeated_and_null_rows(spark, tmp_path):
    import corpus_pipeline as c

    text = "The house of the king is in the north, and the people live by the sea. It was built for them in a year. " * 4
    other = "A story that is told by the old men, with a song for it; this one has no other name, and they like to hear it. " * 4
    rows = [(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (7, text, "en", "a", None), (7, other, None, None, 3), (None, text, "en", "a", 1), (None, None, None, None, None), (8, "", "en", "a", 0)]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "nothing of that stands in any of these documents at all , I think")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = Counter(r.doc_id for r in c.run(spark, f"{tmp_path}/{name}").collect())
        assert got == (Counter({1: 1, 7: 1}) if data else Counter())
