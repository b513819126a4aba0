"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, apart, free, id_and_text, join_unique, mix, ngram_hashes, stage, sub_batches, tidy
from .components import connected_components

#: Sampled tokens of each set by a byte of which sets are first compared; path steps use the same ones in turn, and more where they need them.
SKETCH = 64
#: The chance that two sets at the threshold differ in so many of these bytes that they aren't compared exactly.
SKETCH_LOSS = 1e-6
#: A bucket up to LEAF is compared outright; a larger one is split again, and at full depth dealt out by pairs of blocks.
LEAF, BLOCK = 256, 2048
SHINGLE = 5


@cache
def orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of ``n`` random orders of all tokens; the first ones are the same for every n."""
    draw = np.random.default_rng(20240501).integers(0, 1 << 63, (n, 2), np.uint64)
    return draw[:, :1] << np.uint64(1) | np.uint64(1), draw[:, 1:]


def shingle_set(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words, but not none, are one shingle."""
    return np.unique(ngram_hashes(hashes, min(k, len(hashes)))) if len(hashes) else hashes


def samples(tokens: np.ndarray, n: int = SKETCH) -> np.ndarray:
    """For each of ``n`` random orders of all tokens, the first of the set's tokens: two sets draw the same
    one with the chance of their Jaccard similarity."""
    multiply, add = orders(n)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(tokens), 8192):
            out = np.minimum(out, (tokens[i : i + 8192] * multiply + add).min(1))
    return out


def paths(drawn: np.ndarray, runs: int, depth: int) -> np.ndarray:
    """runs x depth path keys: the tokens drawn so far on a path, in a run of its own."""
    step = mix(drawn[: runs * depth]).reshape(runs, depth)
    out = np.empty_like(step)
    at = mix(np.arange(runs, dtype=np.uint64) + np.uint64(77))
    for d in range(depth):
        at = mix(at ^ step[:, d])
        out[:, d] = at
    return out


def sketch_least(threshold: float) -> int:
    """The most bytes that two sets at the threshold share but for a chance of SKETCH_LOSS; a byte agrees by chance once in 256."""
    p, missed = threshold + (1 - threshold) / 256, 0.0
    for k in range(SKETCH):
        missed += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if missed > SKETCH_LOSS:
            return k
    return SKETCH


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met and been compared with this chance even if its buckets split to full depth."""
    if not 0 < recall < 1 - SKETCH_LOSS:
        raise ValueError(f"a recall of {recall} can't be reached: 0 to {1 - SKETCH_LOSS}, both excluded")
    if threshold >= 1:
        return 1
    return math.ceil(math.log(1 - recall / (1 - SKETCH_LOSS)) / math.log(1 - threshold**depth))


def by_key(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns, of batches sorted by them."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        t = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        if not len(t):
            continue
        keys = np.stack([t.column(i).to_numpy() for i in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield t.slice(a, b - a)
        held = t.slice(edges[-1])
    if held is not None and len(held):
        yield held


def _deal(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """``left, right, mine`` for each pair of blocks that a row takes part in; a group of ``size`` rows has size/block blocks."""
    nb = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("rid"), nb).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    return dealt.withColumns({"left": F.least("mine", "other"), "right": F.greatest("mine", "other")}).drop("other").repartition(
        int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "left", "right").sortWithinPartitions(key, "left", "right")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest member) of each of n nodes under the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks of a pair, and whether they are one block."""
    left, right, mine = (t.column(c).to_numpy() for c in ("left", "right", "mine"))
    if left[0] == right[0]:
        return np.arange(len(t)), np.arange(len(t)), True
    return np.flatnonzero(mine == left), np.flatnonzero(mine == right), False


def _candidates(num: int, den: int):
    least = sketch_least(num / den)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a forest) between the sets of a bucket whose sketches agree."""
        out: list[np.ndarray] = []
        for t in by_key(batches, 3):
            if len(t) < 2:
                continue
            rid, n = t.column("rid").to_numpy(), t.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), SKETCH)
            x, y, same = _sides(t)
            found = []
            for i in range(0, len(x), 128):
                part = x[i : i + 128]
                agree = np.zeros((len(part), len(y)), np.uint8)
                for k in range(SKETCH):
                    agree += sketch[part, k][:, None] == sketch[y, k][None, :]
                near = (agree >= least) & (den * np.minimum(n[part][:, None], n[y][None, :]) >= num * np.maximum(n[part][:, None], n[y][None, :]))
                a, b = np.nonzero(near)
                a, b = part[a], y[b]
                keep = a < b if same else a != b
                found.append(np.stack([a[keep], b[keep]]))
            a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), int)
            root = _forest(len(t), a, b)
            child = np.flatnonzero(root != np.arange(len(t)))
            if len(child):
                out.append(np.stack([rid[child], rid[root[child]]]))
            if sum(e.shape[1] for e in out) > 50_000:
                e = np.concatenate(out, 1)
                yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["u", "v"])
                out = []
        e = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["u", "v"])

    return compare


def _verifier(num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each set its links inside a pair of blocks, by exact similarity, and its root among them."""
        for t in by_key(batches, 3):
            if len(t) < 2:
                continue
            rid, copies = t.column("rid").to_numpy(), t.column("copies").to_numpy()
            sets = [np.frombuffer(b, "<u8") for b in t.column("tokens").to_pylist()]
            size = np.array([len(s) for s in sets])
            x, y, same = _sides(t)
            flat = np.concatenate(sets)
            of = np.repeat(np.arange(len(sets)), size)
            token, at, many = np.unique(flat, return_inverse=True, return_counts=True)
            shared = many > 1
            column = np.cumsum(shared) - 1
            ok = shared[at]
            at, of = column[at[ok]], of[ok]
            order = np.argsort(at, kind="stable")
            at, of = at[order], of[order]
            inter = np.zeros((len(x), len(y)), np.float32)
            place_x, place_y = (np.full(len(sets), -1) for _ in range(2))
            place_x[x], place_y[y] = np.arange(len(x)), np.arange(len(y))
            for first in range(0, int(shared.sum()), 1024):
                i, j = np.searchsorted(at, (first, first + 1024))
                grid = np.zeros((len(sets), 1024), np.float32)
                grid[of[i:j], at[i:j] - first] = 1
                inter += grid[x] @ (grid[x] if same else grid[y]).T
            both = inter.astype(np.int64)
            linked = den * both >= num * (size[x][:, None] + size[y][None, :] - both)
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(sets), np.int64)
            links[x] += linked @ copies[y]
            if not same:
                links[y] += copies[x] @ linked
            a, b = np.nonzero(linked)
            root = _forest(len(sets), x[a], y[b])
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rid[root]), pa.array(links)], ["u", "v", "links"])

    return verify


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, th`` (the text's hash)."""
    return id_and_text(docs, id_col, text_col).withColumn("th", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))


def _classes(rows: DataFrame, threshold: tuple[int, int], shingle: int, recall: float, depth: int) -> DataFrame:
    """``th, n, copies, first_id, cls, links`` of each distinct text: its tokens, rows and smallest id, its class, and the distinct texts' rows linked to it."""
    num, den = threshold
    runs = runs_for(recall, num / den, depth)
    n_samples = max(SKETCH, runs * depth)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in sub_batches(batch, 1):
                seen: dict[bytes, tuple] = {}
                for th, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if th not in seen:
                        s = shingle_set(hashes.of(text), shingle)
                        d = samples(s, n_samples)
                        seen[th] = (len(s), (d[:SKETCH] >> np.uint64(32)).astype(np.uint8).tobytes(), paths(d, runs, depth).view(np.int64).ravel() if len(s) else None)
                n, sketch, keys = zip(*seen.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(n, pa.int64()), pa.array(sketch), pa.array(keys, pa.list_(pa.int64()))],
                                                 ["th", "n", "sketch", "keys"])

    drawn = rows.select("th", "text").mapInArrow(tidy(draw), "th binary, n long, sketch binary, keys array<long>")
    drawn = drawn.groupBy("th").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    sets = stage(drawn.withColumn("rid", F.monotonically_increasing_id()), "join-sets")

    # split buckets: rows of a level are (rid, its run's path keys from this depth on)
    active = sets.where("n > 0").select("rid", F.explode(F.expr(
        f"transform(sequence(0, {runs - 1}), r -> slice(keys, r * {depth} + 1, {depth}))")).alias("path"))
    leaves = None
    for d in range(1, depth + 1):
        level = active.select("rid", "path", F.col("path")[d - 1].alias("key"))
        many = stage(level.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), f"join-sizes{d}")
        total = many.agg(F.sum("size")).first()[0] or 0
        met = stage(join_unique(level, many, "key", "size", total), f"join-level{d}")
        leaf = (met if d == depth else met.where(F.col("size") <= LEAF)).select("key", "rid", "size")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        active = met.where(F.col("size") > LEAF).select("rid", "path")
    met = leaves.join(sets.select("rid", "n", "sketch"), "rid")
    edges = _deal(met, "key", "size", BLOCK).select("key", "left", "right", "mine", "rid", "n", "sketch").mapInArrow(tidy(_candidates(num, den)), "u long, v long")
    group = stage(connected_components(edges).withColumnRenamed("u", "rid"), "join-groups")

    # the members' sets: one row a text, found by text hash and smallest id
    texts = stage(rows.groupBy("th").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "join-texts")
    size = stage(group.groupBy("root").agg(F.count("*").alias("size")), "join-group-sizes")
    members = join_unique(group, size, "root", "size", size.agg(F.sum("size")).first()[0] or 0)
    members = stage(members.join(sets.select("rid", "th"), "rid").join(texts, "th").withColumn("pk", _row_key("th", "first_id")), "join-members")

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in sub_batches(batch, 1):
                tokens = [shingle_set(hashes.of(t), shingle).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.binary())], ["pk", "tokens"])

    _, some = apart(rows.select(_row_key("th", "doc_id").alias("pk"), "text"), F.col("pk"), members, F.col("pk"))
    again = some.mapInArrow(tidy(reread), "pk binary, tokens binary").groupBy("pk").agg(F.first("tokens").alias("tokens"))
    full = members.join(again, "pk").select("rid", "root", "size", "copies", "tokens")
    verified = stage(_deal(full, "root", "size", BLOCK // 2).select("root", "left", "right", "mine", "rid", "copies", "tokens")
                     .mapInArrow(tidy(_verifier(num, den)), "u long, v long, links long"), "join-verified")
    classes = connected_components(verified.select("u", "v")).withColumnRenamed("u", "rid")
    links = verified.groupBy(F.col("u").alias("rid")).agg(F.sum("links").alias("links"))
    known = sets.select("rid", "th", "n").join(texts, "th").join(classes, "rid", "left").join(links, "rid", "left")
    return stage(known.select("th", "n", "copies", "first_id", F.coalesce("root", "rid").alias("cls"), F.coalesce("links", F.lit(0)).alias("links")), "join-known")


def _row_key(th: str, id_col: str) -> Column:
    """Tells rows apart by text and id, null ids included."""
    return F.unhex(F.md5(F.concat(F.col(th), F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")).cast("binary"))))


def _keepers(known: DataFrame) -> DataFrame:
    """``known`` of texts with words, and its class's ``keeper`` (smallest id, then text hash) and ``rows``."""
    of = stage(known.where("n > 0"), "join-worded")
    first = of.groupBy("cls").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "th")).alias("keeper"), F.sum("copies").alias("rows"), F.count("*").alias("texts"))
    first = stage(first.select("cls", F.col("keeper.first_id").alias("class_id"), F.col("keeper.th").alias("class_th"), "rows", "texts"), "join-keepers")
    return join_unique(of, first, "cls", "texts", first.agg(F.sum("texts")).first()[0] or 0)


def jaccard_join(docs: DataFrame, *, threshold: tuple[int, int] = (4, 5), shingle: int = SHINGLE, recall: float = 0.999, depth: int = 4,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose sets of word shingles have a Jaccard similarity of at least ``threshold``.

    Distinct texts are the sets; copies are counted with them.  Chosen paths: in each run a set is put into the
    bucket of a token sampled from it; a bucket above LEAF is split by the next sampled token, up to ``depth``;
    small buckets are compared by brute force on sketches, those still large at full depth by pairs of
    blocks.  Runs are repeated until a pair at the threshold has met, and passed the comparison of sketches, with the chance ``recall``.  What meets
    forms candidate groups; inside a group every pair of sets is compared exactly, so a group's links are
    complete.  Pairs are never written out: a set gets its number of links and its class.  The number of runs and how far sketches may differ follow from ``threshold`` (num, den);
    a low one needs many runs, fewer with a smaller ``depth``.

    Returns ``doc_id, class_id, n_links``, a row a document row: the smallest id among all documents linked to it
    directly or through others, and the number of other documents linked to it directly, copies
    included.  Null and empty texts, and those without a word, have no shingle: each is a class of its own with no
    links.  Fewer words than ``shingle`` are one shingle.  Repeated rows count as copies; null ids are no class's smallest unless all are.  No rows give no rows.
    """
    rows = _rows(docs, id_col, text_col)
    info = _keepers(_classes(rows, threshold, shingle, recall, depth))
    info = stage(info.select("th", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies"), "join-info")
    out = join_unique(rows.select("doc_id", "th"), info, "th", "copies", info.agg(F.sum("copies")).first()[0] or 0, "left")
    return out.select(
        "doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each_class(docs: DataFrame, *, threshold: tuple[int, int] = (4, 5), shingle: int = SHINGLE, recall: float = 0.999, depth: int = 4,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each class of ``jaccard_join``: that of the smallest id, nulls last, then of the smallest text hash.

    Rows are told apart by id and text, so copies under one id or without one go too; of equal rows one stays.  Texts without
    a word are classes of their own: all their rows stay.  Rows of classes of one row, most of a corpus, pass by a filter and are not shuffled.
    """
    rows = _rows(docs, id_col, text_col)
    info = stage(_keepers(_classes(rows, threshold, shingle, recall, depth)).where("rows > 1").select("th", "class_id", "class_th", "copies"), "join-shared")
    th = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    # rows of classes of several rows, by id and text; the keeper passes if it is one row
    pairs = stage(rows.groupBy("th", "doc_id").agg(F.count("*").alias("m")), "join-pairs")
    met = join_unique(pairs, info, "th", "copies", pairs.agg(F.sum("m")).first()[0] or 0)
    kept = (F.col("th") == F.col("class_th")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    hash_, pk, keeps, many = free(docs, "__th", "__pk", "__kept", "__m")
    unsure = stage(met.withColumn(keeps, kept).where(f"not {keeps} or m > 1").select(_row_key("th", "doc_id").alias(pk), keeps, F.col("m").alias(many)), "join-unsure")
    keyed = docs.withColumn(hash_, th).withColumn(pk, _row_key(hash_, f"`{id_col}`")).drop(hash_)
    surely, rest = apart(keyed, F.col(pk), unsure, F.col(pk))
    rest = join_unique(rest, unsure, pk, many, unsure.agg(F.sum(many)).first()[0] or 0, "left")
    once = rest.where(keeps).drop(keeps, many).dropDuplicates([pk])
    return surely.unionByName(rest.where(f"{keeps} is null").drop(keeps, many)).unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))
