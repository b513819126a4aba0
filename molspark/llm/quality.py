"""Quality classifier: heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, small_batches, stage, tidy

# Frequent function words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to a in is that for it as was with be by on are this he at from or an "
    "der die das und in zu den mit von für auf ist im nicht ein eine als auch dem des sich "
    "le la les de des et en un une du que est pour dans qui sur pas au avec ce il elle "
    "el los las y en que un una por con para del se lo al no es su como".split())
_SYMBOLS = b"#$%&*|@^~<>{}\\=_+"


def _shape_bytes() -> bytes:
    out = bytearray(range(256))
    for i in range(256):
        c = chr(i)
        out[i] = ord("a") if i >= 128 or c.islower() else ord("A") if c.isupper() else ord("0") if c.isdigit() else 32 if c.isspace() else i
    return bytes(out)


_SHAPE = _shape_bytes()
_RUN = re.compile(rb"(.)\1+")


class _Collapsed(dict):
    """shape -> the shape with runs of a character taken once; shapes are few, and forgotten at 100,000."""

    def __missing__(self, shape: bytes) -> bytes:
        if len(self) >= 100_000:
            self.clear()
        out = self[shape] = _RUN.sub(rb"\1", shape)
        return out


_COLLAPSED = _Collapsed()


def shapes_of(text: str) -> list[bytes]:
    """The shape of each word: a for a lower-case letter or any other character beyond ASCII, A for a capital, 0 for a digit, signs as they are."""
    return text.encode("utf-8", "surrogatepass").translate(_SHAPE).split()


def statistics(text: str, shapes: list[bytes] | None = None) -> dict[str, float]:
    """The figures that labellers and scorer read; shares are of words unless named otherwise."""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = text.split()
    n = len(tokens) or 1
    count = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    shape_count = Counter(shapes_of(text) if shapes is None else shapes)
    capitals = sum(c * s.count(b"A") for s, c in shape_count.items())
    letters = capitals + sum(c * s.count(b"a") for s, c in shape_count.items())
    return {
        "words": len(tokens),
        "symbols": (len(raw) - len(raw.translate(None, _SYMBOLS))) / max(1, len(raw)),
        "bare": sum(c for s, c in shape_count.items() if b"a" not in s and b"A" not in s and b"0" not in s) / n,
        "capitals": capitals / max(1, letters),
        "ends": sum(c for s, c in shape_count.items() if s[-1] in b".,;:?") / n,
        "shouts": raw.count(b"!") / n,
        "top": max(count.values(), default=0) / n,
        "distinct": len(count) / n,
        "repeats": sum(map(str.__eq__, tokens, tokens[1:])) / n,
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "lines": len(lines),
        "function": sum(c for w, c in count.items() if w.lower() in FUNCTION_WORDS) / n,
    }


#: name -> (good if, bad if) over the statistics; a labeller that says neither abstains.
LABELLERS = {
    "symbols": (lambda s: s["symbols"] < 0.005, lambda s: s["symbols"] > 0.03),
    "bare": (lambda s: s["bare"] < 0.02, lambda s: s["bare"] > 0.15),
    "capitals": (lambda s: s["capitals"] < 0.15, lambda s: s["capitals"] > 0.5),
    "ends": (lambda s: 0.04 <= s["ends"] <= 0.4 and s["words"] >= 10, lambda s: s["words"] >= 20 and s["ends"] < 0.02),
    "shouts": (lambda s: s["shouts"] < 0.05, lambda s: s["shouts"] > 0.3),
    "top": (lambda s: s["words"] >= 20 and s["top"] < 0.15, lambda s: s["words"] >= 8 and s["top"] > 0.25),
    "repeats": (lambda s: s["words"] >= 2 and s["repeats"] < 0.05, lambda s: s["words"] >= 8 and s["repeats"] > 0.2),
    "distinct": (lambda s: s["words"] >= 20 and s["distinct"] > 0.35, lambda s: s["words"] >= 40 and s["distinct"] < 0.12),
    "same_lines": (lambda s: s["lines"] >= 3 and s["same_lines"] < 0.1, lambda s: s["lines"] >= 4 and s["same_lines"] > 0.5),
    "function": (lambda s: s["words"] >= 10 and s["function"] > 0.08, lambda s: s["words"] >= 40 and s["function"] < 0.01),
}


def votes(stats: dict[str, float]) -> str:
    """One character a labeller: + good, - bad, 0 abstains."""
    return "".join("+" if good(stats) else "-" if bad(stats) else "0" for good, bad in LABELLERS.values())


@dataclass(frozen=True)
class LabelModel:
    """Class prior and, for each labeller that votes, the chances of + and - given a good and a bad document.

    Not voting says nothing: most labellers abstain because a text is short.
    """

    prior: float
    chances: np.ndarray  # labellers x 2 (good, bad) x 2 (+ -)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Chance that a document with these votes is good."""
        v = np.array([["+-0".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), -1)
        log = np.concatenate([np.log(self.chances), np.zeros((*self.chances.shape[:2], 1))], 2)
        like = np.stack([log[np.arange(v.shape[1]), k, v].sum(1) for k in (0, 1)], 1) + np.log([self.prior, 1 - self.prior])
        return 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -50, 50)))


def fit_label_model(patterns: dict[str, int], rounds: int = 60, smooth: float = 1.0) -> LabelModel:
    """EM over the counts of vote patterns, at most three to the number of labellers, whatever the corpus.

    Starts from the votes cast: two bad ones tell more than many good ones, as each fault is rare.  Without a single pattern the model is uniform.
    """
    keys = list(patterns)
    m = len(LABELLERS)
    if not keys:
        return LabelModel(0.5, np.full((m, 2, 2), 1 / 2))
    n = np.array([patterns[k] for k in keys], np.float64)
    hot = np.stack([[["+-0"[j] == c for j in range(2)] for c in k] for k in keys]).astype(np.float64)
    good, bad = hot[:, :, 0].sum(1), hot[:, :, 1].sum(1)
    post = np.where(bad >= 2, 0.02, np.where(bad == 1, 0.3, (good + 1) / (good + bad + 1.2)))
    model = LabelModel(0.5, np.full((m, 2, 2), 1 / 2))
    for _ in range(rounds):
        chances = np.stack([(hot * (n * w)[:, None, None]).sum(0) + smooth for w in (post, 1 - post)], 1)
        chances /= chances.sum(2, keepdims=True)
        model = LabelModel(float(np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3)), chances)
        post = model.posterior(keys)
    return model


def hashed_features(shapes: list[bytes], stats: dict[str, float], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights (root shares) of hashed collapsed word shapes, pairs of them, and binned statistics."""
    shapes = list(map(_COLLAPSED.__getitem__, shapes))
    n = max(1, len(shapes))
    found: dict[int, float] = {}
    for prefix, count in ((b"1", Counter(shapes)), (b"2", Counter(zip(shapes, shapes[1:], strict=False)))):
        for key, c in count.items():
            h = zlib.crc32(prefix + (key if isinstance(key, bytes) else b" ".join(key))) % dims
            found[h] = found.get(h, 0.0) + c / n
    out = {h: x**0.5 for h, x in found.items()}
    for name, value in stats.items():
        level = int(np.log2(value + 1)) if name in ("words", "lines") else int(min(value, 1.0) * 20)
        out[zlib.crc32(f"{name}={level}".encode()) % dims] = 1.0
    return np.fromiter(out.keys(), np.int64, len(out)), np.fromiter(out.values(), np.float64, len(out))


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> tuple[float, str]:
        """(chance that the text is good, votes); 0 for a null or blank text."""
        if not text or not text.strip():
            return 0.0, "0" * len(LABELLERS)
        shapes = shapes_of(text)
        stats = statistics(text, shapes)
        at, x = hashed_features(shapes, stats, len(self.weights))
        z = float(self.weights[at] @ x) + self.bias
        return 1 / (1 + float(np.exp(-np.clip(z, -50, 50)))), votes(stats)


def _train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dims: int, epochs: int = 30, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by AdaGrad, rows in the given order, so the same rows give the same model."""
    w, b = np.zeros(dims), 0.0
    gw, gb = np.full(dims, 1e-2), 1e-2
    for _ in range(epochs):
        for (at, x), t in zip(rows, target.tolist(), strict=True):
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -50, 50))) - t
            d = g * x + l2 * w[at]
            gw[at] += d * d
            w[at] -= 0.3 * d / np.sqrt(gw[at])
            gb += g * g
            b -= 0.3 * g / gb**0.5
    return w, b


def fit_quality(docs: DataFrame, *, text_col: str = "text", sample_rows: int = 4_000, sample_bytes: int = 64 << 20, dims: int = 1 << 14) -> QualityModel:
    """Label model over the votes of all documents, and a scorer fitted on at most ``sample_rows`` of them, of ``sample_bytes`` in all.

    The vote patterns of the whole corpus are counted (a bounded table), EM estimates how often each
    labeller is right, and the posterior of a document's pattern is its label.  The scorer's sample is drawn by
    hash, half from documents held good and half from those held bad where there are as many, distinct texts only (copies count once, so
    they crowd out no class); a text longer than what is left of its half of the bytes isn't drawn.  Null and blank texts don't vote; without any other every text is scored by
    an empty model, 0.5.
    """
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([votes(statistics(t)) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1), batch.column(2)], ["votes", "h", "size"])

    texts = small_batches(docs).select(F.col(f"`{text_col}`").alias("text")).where("text is not null and trim(text) != ''").withColumns({"h": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})
    voted = stage(texts.mapInArrow(tidy(vote), "votes string, h long, size long"), "quality-votes")
    patterns = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_label_model(patterns)
    posterior = dict(zip(patterns, model.posterior(list(patterns)), strict=True)) if patterns else {}
    chosen: list[tuple[str, int]] = []
    for is_good in (True, False):
        keys = [k for k, p in posterior.items() if (p >= 0.5) == is_good]
        if keys:
            held = voted.where(F.col("votes").isin(keys))
            distinct = held.agg(F.approx_count_distinct("h", 0.05)).first()[0]
            share = min(1.0, 3 * (sample_rows // 2) / max(1, distinct))  # three times as many, so a few percent of error leave enough
            some = held.where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * share) + 1)
            left = sample_bytes // 2
            for r in some.dropDuplicates(["h"]).orderBy("h").limit(sample_rows // 2).collect():
                if r.size <= left:
                    left -= r.size
                    chosen.append((r.votes, r.h))
    if not chosen:
        return QualityModel(model, np.zeros(dims), 0.0)
    label = {h: posterior[v] for v, h in chosen}
    wanted = docs.sparkSession.createDataFrame([(h,) for h in label], "h long")  # sample_rows at most
    sample = sorted({r.h: r.text for r in texts.join(F.broadcast(wanted), "h", "left_semi").dropDuplicates(["h"]).collect()}.items(),
                    key=lambda kv: zlib.crc32(str(kv[0]).encode()))
    rows = [hashed_features(shapes_of(t), statistics(t), dims) for _, t in sample]
    return QualityModel(model, *_train(rows, np.array([label[h] for h, _ in sample]), dims))


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``doc_id, quality (0 to 1), keep (quality at least 0.5), votes``.

    One row a row, no shuffle.  A null or blank text scores 0 and is not kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch.column(1).to_pylist()]
            q = np.array([s for s, _ in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(q, pa.float64()), pa.array((q >= 0.5).tolist(), pa.bool_()), pa.array([v for _, v in found], pa.string())],
                ["doc_id", "quality", "keep", "votes"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(tidy(run), f"doc_id {src.schema[0].dataType.simpleString()}, quality double, keep boolean, votes string")


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text the model keeps; null and blank texts go."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t)[0] >= 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)
