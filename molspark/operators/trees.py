"""Parsimony of lineage trees given as edges."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bound_batches, materialise


def _fold(sets: Column) -> Column:
    """Fitch over ordered child sets: (set, unions); empty sets are missing and left out."""
    known = F.filter(sets, lambda s: F.size(s) > 0)
    start = F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        both = F.array_intersect(acc["s"], s)
        return F.when(F.size(acc["s"]) == 0, F.struct(s.alias("s"), acc["n"].alias("n"))).when(
            F.size(both) > 0, F.struct(both.alias("s"), acc["n"].alias("n"))).otherwise(F.struct(F.array_union(acc["s"], s).alias("s"), (acc["n"] + 1).alias("n")))

    return F.aggregate(known, start, step)


def _climb(level: DataFrame, edges: DataFrame, keys: list[str], values: list[str], fold: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Go up from the leaves of all trees together: a node is done when all its children are.

    ``level``: keys, node and values of the leaves; ``fold`` makes them of a node (``keys, node``) from its children ``cs``, in the order of their names.
    Returns the rows of all nodes without a parent; none if no node has a child.  As many steps as the tree is deep; each is stored.
    """
    own_tree = [k for k in keys if k in edges.columns]
    waiting = edges.groupBy(*own_tree, "parent").agg(F.count("*").alias("children"))
    pending = total = None
    while True:
        up = level.join(edges.withColumnRenamed("child", "node").hint("merge"), [*own_tree, "node"]).select(*keys, "parent", F.struct("node", *values).alias("c"))
        pending = up if pending is None else pending.unionByName(up)
        groups = pending.groupBy(*keys, "parent").agg(F.array_sort(F.collect_list("c")).alias("cs"), F.count("*").alias("k")).join(waiting.hint("merge"), [*own_tree, "parent"])  # children of one node
        level = materialise(fold(groups.where("k = children").select(*keys, F.col("parent").alias("node"), "cs")), "fitch")
        if level.isEmpty():
            return total
        pending = materialise(pending.join(level.select(*keys, F.col("node").alias("parent")).hint("merge"), [*keys, "parent"], "left_anti"), "fitch")
        roots = level.join(edges.select(*own_tree, F.col("child").alias("node")).distinct(), [*own_tree, "node"], "left_anti")
        total = roots if total is None else total.unionByName(roots)


def _leaves(edges: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node``: the leaves of each key's tree."""
    own_tree = [k for k in keys if k in edges.columns]
    leaves = edges.select(*own_tree, F.col("child").alias("node")).join(edges.select(*own_tree, F.col("parent").alias("node")).distinct(), [*own_tree, "node"], "left_anti")
    return cells.join(leaves, own_tree) if own_tree else cells.crossJoin(leaves)


#: Edges of a tree, and states of a character in it, that a task folds by itself; larger trees go up level by level as tables.
TREE_EDGES = 100_000
#: Bytes of drawn hashes that a worker remembers, and of state sets that it holds at once.
HASH_BYTES, SET_BYTES = 64 << 20, 32 << 20


def _order(edges: list[dict]) -> tuple[list[tuple], set]:
    """(node, its children by name) from the leaves up, as far as all children of a node are done, and the leaves."""
    below, above = defaultdict(list), defaultdict(list)
    for e in edges:
        up = above[e["child"]]
        if e["parent"] is not None:
            below[e["parent"]].append(e["child"])
            up.append(e["parent"])
    left = {node: len(children) for node, children in below.items()}
    leaves = {node for node in above if node is not None and node not in below}
    ready, out = list(leaves), []
    while ready:
        for parent in above.get(ready.pop(), ()):
            left[parent] -= 1
            if not left[parent]:
                out.append((parent, sorted(below[parent])))
                ready.append(parent)
    return [(node, children, node not in above) for node, children in out], leaves


def _split(edges: DataFrame, states: DataFrame, keys: list[str], bound: int) -> tuple[DataFrame, DataFrame | None]:
    """A row a key of the trees within ``bound``: keys, ``leaves`` (leaf, state) and ``edges`` (parent, child); and the keys of the larger trees, if any."""
    bound_batches(edges.sparkSession)
    own_tree = [k for k in keys if k in edges.columns]
    sizes = edges.groupBy(*own_tree).agg(F.count("*").alias("n"))
    marked = states.groupBy(*keys).agg(F.count("*").alias("n")).groupBy(*own_tree).agg(F.max("n").alias("n"))
    large = materialise(sizes.unionByName(marked).groupBy(*own_tree).agg(F.max("n").alias("n")).where(F.col("n") > bound).select(*own_tree, "n"), "large-trees")  # a row for each ``bound`` edges or states at most
    if large.isEmpty():
        large = None
    elif not own_tree:
        return None, states.select(*keys).distinct()
    else:
        large = large.select(*own_tree)
        states, edges = (df.join(large, own_tree, "left_anti") for df in (states, edges))
    shapes = edges.groupBy(*own_tree).agg(F.collect_list(F.struct("parent", "child")).alias("edges"))  # ``bound`` at most
    leaves = states.groupBy(*keys).agg(F.collect_list(F.struct("leaf", "state")).alias("leaves"))
    # a file's size says little of the arrays made of it, so neither side is sent through the driver
    return (leaves.join(shapes.hint("merge"), own_tree) if own_tree else leaves.crossJoin(shapes)).select(*keys, "leaves", "edges"), large


def _of(df: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of the large trees."""
    on = [k for k in large.columns if k in df.columns]
    return df.join(large, on, "left_semi") if on else df


def parsimony_score(edges: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("tree_id", "site"), tree_edges: int | None = None) -> DataFrame:
    """Fitch score of each (tree, character): the number of unions from the leaves up; a state below 0 is missing.

    A tree is folded where its edges and the states of a character meet; of trees with more than ``tree_edges`` edges or states a character levels
    go up one at a time, all together.
    ``edges``: parent, child, of one tree for all keys, or with key columns (``tree_id``), of a tree each; ``states``: keys, leaf, state.
    """
    keys = [*keys]
    small, large = _split(edges, states, keys, TREE_EDGES if tree_edges is None else tree_edges)
    found = None
    if small is not None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, scores, last, shape = [], [], None, None
                for i, (leaves, tree) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                    if tree != last:
                        last, shape = tree, _order(tree)
                    order, tips = shape
                    bit: dict = {}
                    sets, n = {}, {}
                    for x in leaves:
                        sets[x["leaf"]] = 1 << bit.setdefault(x["state"], len(bit)) if x["state"] is not None and x["state"] >= 0 else 0
                    sets = {tip: sets.get(tip, 0) for tip in tips}
                    score, ended = 0, False
                    for node, children, root in order:
                        at = unions = 0
                        for c in children:
                            unions += n.get(c, 0)
                            if s := sets[c]:
                                both = at & s
                                unions += bool(at) and not both
                                at = both or at | s
                        sets[node], n[node] = at, unions
                        if root:
                            score, ended = score + unions, True
                    if ended:
                        rows.append(i)
                        scores.append(score)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))), pa.array(scores, pa.int64())], names=[*keys, "score"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.select(*keys).schema)
        found = small.mapInArrow(run, f"{kinds}, score long")
        if large is None:
            return found
    rest = _score_by_levels(_of(edges, large), _of(states, large), keys)
    return rest if found is None else found.unionByName(rest)


def _score_by_levels(edges: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    own = F.when(F.col("state") >= 0, F.array(F.col("state").cast("int"))).otherwise(F.array().cast("array<int>"))
    done = _leaves(edges, states.select(*keys).distinct(), keys).join(states.select(*keys, F.col("leaf").alias("node"), own.alias("s")), [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("s", F.array().cast("array<int>")).alias("s"), F.lit(0).cast("long").alias("n"))

    def fold(full: DataFrame) -> DataFrame:
        below = F.aggregate("cs", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
        return full.withColumn("f", _fold(F.transform("cs", lambda c: c["s"]))).select(*keys, "node", F.col("f.s").alias("s"), (F.col("f.n") + below).alias("n"))

    roots = _climb(materialise(done, "fitch"), edges, keys, ["s", "n"], fold)
    return (done if roots is None else roots).groupBy(*keys).agg(F.sum("n").alias("score"))


#: Bytes of permuted states that a task holds of one tree and character; permutations are dealt to parts where a tree has too many leaves.
PERMUTED_BYTES = 128 << 20


def _permuted(n: int, at_once: int, seed: int, words: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the leaves of one (tree, character), each leaf's state in each permutation of a part as a bit mask."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf", kind="stable", na_position="first").reset_index(drop=True)
        states = pdf["state"].fillna(-1).to_numpy().astype(np.int64)
        known, number = np.unique(states[states >= 0], return_inverse=True)
        bits = np.zeros((len(states), words), np.uint64)
        bits[np.flatnonzero(states >= 0), number // 64] = np.uint64(1) << (number % 64).astype(np.uint64)
        names = ["" if x is None else f":{x}" for x in pdf["leaf"]]
        part = int(pdf["part"].iloc[0])
        perms = range(part * at_once, min(n + 1, (part + 1) * at_once))
        out = np.zeros((len(states), len(perms), words), np.uint64)
        for k, p in enumerate(perms):
            if p:  # the same order as a sort by the text of the hash, then by the leaf
                h = np.frombuffer(b"".join(hashlib.md5(f"{seed}:{p}{x}".encode()).digest() for x in names), ">u8").reshape(-1, 2)
                out[:, k] = bits[np.lexsort((h[:, 1], h[:, 0]))]
            else:
                out[:, k] = bits
        return pd.DataFrame({"tree_id": pdf["tree_id"], "site": pdf["site"], "part": part, "node": pdf["leaf"], "s": [x.tobytes() for x in out]})

    return run


def parsimony_null(edges: DataFrame, states: DataFrame, n: int = 1000, seed: int = 0, tree_edges: int | None = None) -> DataFrame:
    """Observed score of each (tree, character) against ``n`` permutations of its leaf states: mean, sd, z and p = (1 + as low) / (n + 1).

    A tree and a character are one row, folded in its task for all permutations at once, as vectors of bit masks; nothing but the outcome leaves it.
    Trees with more than ``tree_edges`` edges or states a character go up level by level.
    """
    keys = ["tree_id", "site"]
    small, large = _split(edges, states, keys, TREE_EDGES if tree_edges is None else tree_edges)
    found = None
    if small is not None:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.select(*keys).schema)
        found = small.mapInArrow(_null_of(n, seed), f"{kinds}, observed long, null_mean double, null_sd double, p double")
    if large is not None:
        rest = _null_by_levels(_of(edges, large), _of(states, large), n, seed)
        found = rest if found is None else found.unionByName(rest)
    return found.withColumn("z", F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")))


def _null_of(n: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of ``tree_id, site, leaves, edges`` the observed score and the mean, deviation and p of the permutations."""
    hashes: dict[str, np.ndarray] = {}

    def drawn(name: str, perms: range) -> np.ndarray:
        """The hashes of a leaf in the permutations."""
        if name in hashes and len(perms) == n + 1:
            return hashes[name]
        h = np.frombuffer(b"".join(hashlib.md5(f"{seed}:{p}{name}".encode()).digest() for p in perms), ">u8").reshape(-1, 2).astype(np.uint64)
        if len(perms) == n + 1 and (len(hashes) + 1) * h.nbytes <= HASH_BYTES:
            hashes[name] = h
        return h

    def scores(leaves: list[dict], shape: tuple[list[tuple], set]) -> np.ndarray | None:
        order, tips = shape
        if not any(root for _, _, root in order):
            return None
        leaves = sorted(leaves, key=lambda x: (x["leaf"] is not None, x["leaf"]) if x["leaf"] is not None else (False,))
        states = np.array([-1 if x["state"] is None else x["state"] for x in leaves], np.int64)
        known, number = np.unique(states[states >= 0], return_inverse=True)
        words = max(1, -(-len(known) // 64))
        bits = np.zeros((len(states), words), np.uint64)
        bits[np.flatnonzero(states >= 0), number // 64] = np.uint64(1) << (number % 64).astype(np.uint64)
        names = ["" if x["leaf"] is None else f":{x['leaf']}" for x in leaves]
        at_once = max(1, min(n + 1, SET_BYTES // (24 * words * max(1, len(leaves)))))
        out = []
        for first in range(0, n + 1, at_once):
            perms = range(first, min(n + 1, first + at_once))
            h = np.stack([drawn(x, perms) for x in names], 1)  # permutation, leaf, half
            take = np.argsort(h[:, :, 0], axis=1, kind="stable")
            halves = np.take_along_axis(h[:, :, 0], take, 1)
            for p in np.flatnonzero((halves[:, 1:] == halves[:, :-1]).any(axis=1)):
                take[p] = np.lexsort((h[p, :, 1], h[p, :, 0]))
            if not first:
                take[0] = np.arange(len(leaves))  # the observed states
            none = np.zeros((len(perms), words), np.uint64)
            sets = {x["leaf"]: bits[take[:, i]] for i, x in enumerate(leaves)}
            sets = {tip: sets.get(tip, none) for tip in tips}
            total, below = np.zeros(len(perms), np.int64), {}
            for node, children, root in order:
                s, score = none, np.zeros(len(perms), np.int64)
                for c in children:
                    other = sets[c]
                    if c in below:
                        score += below[c]
                    both = s & other
                    apart = ~both.any(axis=1)  # one side is missing, or nothing in common
                    score += apart & s.any(axis=1) & other.any(axis=1)
                    s = np.where(apart[:, None], s | other, both)
                sets[node], below[node] = s, score
                if root:
                    total += score
            out.append(total)
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, told, last, shape = [], [], None, None
            for i in range(batch.num_rows):
                tree = batch.column(3)[i].as_py()
                if tree != last:
                    last, shape = tree, _order(tree)
                score = scores(batch.column(2)[i].as_py(), shape)
                if score is not None:
                    null = score[1:]
                    rows.append(i)
                    told.append((int(score[0]), float(null.mean()) if n else None, float(null.std(ddof=1)) if n > 1 else None, (1 + int((null <= score[0]).sum())) / (n + 1)))
            columns = list(zip(*told, strict=True)) or [()] * 4
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])],
                                             names=["tree_id", "site", "observed", "null_mean", "null_sd", "p"])

    return run


def _null_by_levels(edges: DataFrame, states: DataFrame, n: int, seed: int) -> DataFrame:
    """The same of large trees.  A node is one row: its state sets of all permutations are one array of bit masks, folded by AND and OR, with an array of their scores.

    Trees with so many leaves that these arrays take more than PERMUTED_BYTES have a row for each part of the permutations.
    """
    keys = ["tree_id", "site", "part"]
    most = states.groupBy("tree_id", "site").agg(F.count("*").alias("leaves"), F.countDistinct(F.when(F.col("state") >= 0, F.col("state"))).alias("k")).agg(F.max("leaves"), F.max("k")).first()
    words = max(1, -(-(most[1] or 1) // 64))
    at_once = max(1, min(n + 1, PERMUTED_BYTES // (8 * words * max(1, most[0] or 1))))
    parts = -(-(n + 1) // at_once)
    dealt = states.select("tree_id", "site", "leaf", "state").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tree, site, leaf = (states.schema[c].dataType.simpleString() for c in ("tree_id", "site", "leaf"))
    own = dealt.groupBy("tree_id", "site", "part").applyInPandas(_permuted(n, at_once, seed, words), f"tree_id {tree}, site {site}, part int, node {leaf}, s binary")
    done = _leaves(edges, dealt.select(*keys).distinct(), keys).join(own, [*keys, "node"], "left").select(*keys, "node", "s", F.lit(None).cast("binary").alias("n"))
    kinds = {f.name: f for f in done.schema}

    def fold(full: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets, scores = [], []
                for part, children in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    size = min(at_once, n + 1 - part * at_once)
                    s, score = np.zeros((size, words), np.uint64), np.zeros(size, np.uint32)
                    for c in children:
                        if c["n"]:
                            score += np.frombuffer(c["n"], np.uint32)
                        if c["s"]:
                            other = np.frombuffer(c["s"], np.uint64).reshape(size, words)
                            both = s & other
                            apart = ~both.any(axis=1)  # one side is missing, or nothing in common
                            score += apart & s.any(axis=1) & other.any(axis=1)
                            s = np.where(apart[:, None], s | other, both)
                    sets.append(s.tobytes())
                    scores.append(score.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary()), pa.array(scores, pa.binary())], names=[*keys, "node", "s", "n"])

        return full.select(*keys, "node", "cs").mapInArrow(run, f"tree_id {tree}, site {site}, part int, node {kinds['node'].dataType.simpleString()}, s binary, n binary")

    roots = _climb(materialise(done, "fitch"), edges, keys, ["s", "n"], fold)
    roots = done if roots is None else roots

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (part, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                size = min(at_once, n + 1 - part * at_once)
                score = np.frombuffer(raw, np.uint32) if raw else np.zeros(size, np.uint32)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column(0).take(pa.array([0] * size)), row.column(1).take(pa.array([0] * size)), pa.array(np.arange(size) + part * at_once), pa.array(score.astype(np.int64))],
                                                 names=["tree_id", "site", "perm", "score"])

    scores = roots.select("tree_id", "site", "part", "n").mapInArrow(told, f"tree_id {tree}, site {site}, perm long, score long").groupBy("tree_id", "site", "perm").agg(F.sum("score").alias("score"))
    of = F.when(F.col("perm") > 0, F.col("score"))
    null = scores.groupBy("tree_id", "site").agg(F.max(F.when(F.col("perm") == 0, F.col("score"))).alias("observed"), F.avg(of).alias("null_mean"), F.stddev_samp(of).alias("null_sd"),
                                                 F.collect_list(of).alias("drawn"))  # n numbers
    low = F.size(F.filter("drawn", lambda x: x <= F.col("observed")))
    return null.select("tree_id", "site", "observed", "null_mean", "null_sd", ((1 + low) / (F.size("drawn") + 1)).alias("p"))


def tree_qc_summary(stats: DataFrame, states: DataFrame) -> DataFrame:
    """Per tree: characters analysed and skipped (at most one state), mean z, one-sample t, and a class by mean z: good below -2, moderate below -1."""
    n_states = states.where("state >= 0").groupBy("tree_id", "site").agg(F.countDistinct("state").alias("k"))
    used = n_states.groupBy("tree_id").agg(F.sum((F.col("k") > 1).cast("long")).alias("analysed"), F.sum((F.col("k") <= 1).cast("long")).alias("skipped"))
    z = stats.join(n_states.where("k > 1"), ["tree_id", "site"]).groupBy("tree_id").agg(F.avg("z").alias("mean_z"), (F.avg("z") / (F.stddev_samp("z") / F.sqrt(F.count("z")))).alias("t"))
    cls = F.when(F.col("mean_z") < -2, "good").when(F.col("mean_z") < -1, "moderate").otherwise("poor")
    return used.join(z, "tree_id", "left").withColumn("quality", cls)
