"""Shortest contigs of many groups at once, and what is chosen and counted where they are assembled."""

import random

import pytest

from molspark.operators import kmers
from molspark.operators.contigs import shortest_contigs


def damaged(rng, text, letters):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(text) + 1)
        text = rng.choice((text[:i] + text[i + 1 :], text[:i] + rng.choice(letters) + text[i + 1 :], text[:i] + text[max(0, i - 20) : i] + text[i:], text[i:], text[:i] + "".join(rng.choices(letters, k=3)) + text[i:]))
    return text


@pytest.mark.parametrize(("letters", "ks"), [("AC", [2, 3]), ("ACGT", [3, 5]), ("ACGT", [13, 17]), ("ACGTN", [9]), ("ACGTNé𝔊", [20, 33])])
def test_many_groups_at_once_are_as_one_by_one(letters, ks):
    """The same contigs as the walk k-mer by k-mer: branches, ties, rings, reads shorter than k, empty and lone groups, texts of many letters."""
    rng, some = random.Random(3), 0
    for _ in range(60):
        text = "".join(rng.choices(letters, k=rng.randrange(8, 90)))
        anchors = text[: rng.randrange(8)], text[len(text) - rng.randrange(8) :]
        sets = [sorted({damaged(rng, text, letters): rng.randrange(1, 4) for _ in range(rng.randrange(6))}.items()) for _ in range(rng.randrange(1, 12))]
        want = [kmers._contigs(dict(x), ks, [2, 1, 3], "shortest_path", *anchors, 0) for x in sets]
        assert shortest_contigs(sets, ks, [2, 1, 3], *anchors) == want
        some += sum(bool(c) for x in want for c in x)
    assert some > 500


def made(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("ACGT", k=60))
    rows = [("a", text), ("a", text), ("a", text[:40] + "T" + text[41:]), (None, text), (None, text), ("n", None), ("s", "AC"), ("b", text[:20]), ("b", text[:18]), ("c", text), ("c", None), ("d", text[:15] + text[45:]), ("d", text)]
    return text, spark.createDataFrame([*rows, *(("many", text[i : i + 30]) for i in range(31))], "g string, r2_seq string")


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("min_reads", [1, 2])
def test_best_contigs_are_chosen_in_the_task(spark, longest, min_reads):
    """As from the whole grid, for groups in a task and by tables; reads are neither joined nor counted apart."""
    text, df = made(spark)
    anchors = {"start_anchor": text[:9], "end_anchor": text[-9:]}
    n = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    grid = {}
    for r in kmers.assembly_sweep(df, ["g"], [7, 9], [1, 2], **anchors).collect():
        both, size = text[:9] in r.contig and text[-9:] in r.contig, len(r.contig)
        grid.setdefault(r.g, []).append(((size, both) if longest else (both, size), -r.k, -r.min_coverage, r.contig))
    want = {g: (max(x)[3], -max(x)[1], -max(x)[2], not max(x)[3]) for g, x in grid.items() if min_reads == 1 or n[g] >= min_reads and g is not None}
    for bound in (None, 0, 100):
        got = kmers.assembly_optimize(df, ["g"], [7, 9], [1, 2], prioritize_length=longest, min_reads=min_reads, task_edges=bound, **anchors)
        assert {r.g: (r.contig, r.k, r.min_coverage, r.failed) for r in got.collect()} == want
        if bound is None:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan


def test_contig_table_counts_reads_in_the_task(spark):
    """Reads of a group, null ones included, come with its contig: no join of the reads or the contigs with counts."""
    text, df = made(spark)
    anchors = {"start_anchor": text[:9], "end_anchor": text[-9:]}
    contigs = {r.g: r.contig for r in kmers.assemble_umis(df, ["g"], k=9, min_coverage=1, **anchors).collect()}
    n = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    want = {(g, contigs[g], n[g], len(contigs[g]), "s1") for g in n if n[g] >= 2 and g is not None}
    for bound in (None, 0, 100):
        got = kmers.contig_table(df, ["g"], 2, "s1", k=9, min_coverage=1, task_edges=bound, **anchors)
        assert got.columns == ["g", "contig", "reads", "length", "sample_id"]
        assert {tuple(r) for r in got.collect()} == want and len(want) == 5
        if bound is None:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("query", ["assemble_umis", "assembly_sweep", "assembly_optimize", "contig_table"])
def test_reads_are_shuffled_once(spark, monkeypatch, query):
    """To as many tasks as the session has, without an aggregate before; null keys are left out in the task, so no filter makes the keys twice."""
    text, df = made(spark)
    plans, store = [], kmers.materialise

    def stored(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return store(frame, name)

    monkeypatch.setattr(kmers, "materialise", stored)
    options = {"start_anchor": text[:9], "end_anchor": text[-9:]}
    calls = {"assemble_umis": lambda: kmers.assemble_umis(df, ["g"], k=9, min_coverage=1, **options), "contig_table": lambda: kmers.contig_table(df, ["g"], 2, "s", k=9, min_coverage=1, **options),
             "assembly_sweep": lambda: kmers.assembly_sweep(df, ["g"], [7, 9], [1], **options), "assembly_optimize": lambda: kmers.assembly_optimize(df, ["g"], [7, 9], [1], min_reads=2, **options)}
    assert calls[query]().count() > 0
    (plan,) = plans
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Aggregate" not in plan and "Filter" not in plan and "Join" not in plan


def test_groups_with_the_same_reads_are_assembled_once(spark):
    """What a worker remembers holds for its options alone and is bounded by letters."""
    known = kmers._known_contigs(([3], [1]))
    known.learn((("ACGT", 1),), ["ACGT"])
    assert kmers._known_contigs(([3], [1])).get((("ACGT", 1),)) == ["ACGT"]
    assert kmers._known_contigs(([5], [1])).get((("ACGT", 1),)) is None
    known = kmers._Contigs(())
    for i in range(20):
        known.learn((("A" * (kmers.KNOWN_LETTERS // 10 + i), 1),), [""])
    assert known.held <= kmers.KNOWN_LETTERS and len(known.known) == 9 and known.get((("A" * (kmers.KNOWN_LETTERS // 10), 1),)) is None
