"""Sources and operators at sizes and cuts where the plain way would be one task: FASTQ ranges, range joins, ranks, permutations."""

import random

import pytest
from pyspark.sql import functions as F

from molspark.operators import align, dictionaries, ibars, kmers, reads, umi
from molspark.operators.intervals import interval_join
from molspark.operators.ranks import global_rank
from molspark.sources import fastq


def records(n, seed, longest=60):
    """Records whose quality lines begin with @ and + often, some with no letters at all."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice((0, 1, 5, rng.randrange(longest)))
        seq = "".join(rng.choices("ACGTN", k=size))
        out.append((f"r{i} {seed}", seq, "".join(rng.choices("@+I#5", k=size))))
    return out


def write(path, rows, end="\n"):
    path.write_bytes("".join(f"@{r}{end}{s}{end}+{end}{q}{end}" for r, s, q in rows).encode())
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_ranges_at_every_cut(tmp_path, end):
    rows = records(60, 1)
    path = write(tmp_path / "x.fastq", rows, end)
    size = (tmp_path / "x.fastq").stat().st_size
    for cut in range(1, size):
        got = [*fastq._records(path, path, 0, cut), *fastq._records(path, path, cut, size)]
        assert got == rows, cut


@pytest.mark.parametrize("range_bytes", [37, 100, 1 << 20])
def test_fastq_by_many_tasks(spark, tmp_path, range_bytes):
    rows = records(40, 2)
    path = write(tmp_path / "x.fastq", rows)
    df = fastq.fastq_scan(spark, path, range_bytes=range_bytes)
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    if range_bytes == 100:
        assert df.rdd.getNumPartitions() > 3
    assert fastq.fastq_scan(spark, path, range_bytes=range_bytes, limit=3).count() == 3


@pytest.mark.parametrize("range_bytes", [90, 700, 1 << 20])
def test_pairs_by_many_tasks(spark, tmp_path, range_bytes):
    """Parts of both files differ in their numbers of records; pairs are those of the sequential reading."""
    for d, seed, longest in (("one", 3, 20), ("two", 4, 90)):
        (tmp_path / d).mkdir()
        for k in range(2):
            write(tmp_path / d / f"f{k}.fastq", records(90 + k, 10 * seed + k, longest))
    want = [(a[0].split(" ")[0], a[1], a[2], b[1], b[2]) for k in range(2) for a, b in zip(records(90 + k, 30 + k, 20), records(90 + k, 40 + k, 90), strict=True)]
    df = fastq.paired_fastq_scan(spark, str(tmp_path / "one"), str(tmp_path / "two"), range_bytes=range_bytes)
    assert sorted(map(tuple, df.collect())) == sorted(want)
    if range_bytes == 90:
        assert df.rdd.getNumPartitions() > 10
        write(tmp_path / "two" / "f1.fastq", records(80, 5))
        with pytest.raises(Exception, match="different numbers of records"):
            fastq.paired_fastq_scan(spark, str(tmp_path / "one"), str(tmp_path / "two"), range_bytes=range_bytes).collect()


@pytest.mark.parametrize("bin_rows", [None, 7])
def test_interval_join_against_a_plain_one(spark, bin_rows):
    rng = random.Random(5)
    left = [(i, rng.choice(("c1", "c2", None)), a, a + rng.choice((0, 3, 400, -1))) for i, a in enumerate(rng.choices(range(-300, 900), k=300))] + [(999, "c1", None, 4)]
    right = [(i, rng.choice(("c1", "c2")), a, a + rng.choice((0, 50, 1000))) for i, a in enumerate(rng.choices(range(-300, 900), k=60))]
    a, b = spark.createDataFrame(left, "id int, bin string, lo int, hi int"), spark.createDataFrame(right, "no int, bin string, a int, part int")
    got = interval_join(a, b, ["bin"], (F.col("lo"), F.col("hi")), (F.col("a"), F.col("part")), 100, bin_rows).select("id", "no").collect()
    want = [(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] is not None and x[2] <= x[3] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_hundred_thousand_loci_of_one_chromosome(spark):
    """100,000 loci and as many reads of one chromosome: a join on its name alone would meet 10**10 pairs."""
    loci = spark.range(100_000).select(F.concat(F.lit("g"), "id").alias("locus"), F.lit("chr1").alias("rname"), (F.col("id") * 200).alias("locus_pos"))
    reads = spark.range(100_000).select("id", F.lit("chr1").alias("rname"), (F.col("id") * 200 + F.col("id") % 90).alias("pos"))
    out = interval_join(reads, loci, ["rname"], (F.col("pos"), F.col("pos")), (F.col("locus_pos") - 60, F.col("locus_pos") + 60), 1000)
    assert out.count() == sum(i % 90 <= 60 for i in range(100_000))


def test_global_rank(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("part"), F.col("id").alias("before")).distinct().repartition(7)
    got = {(r.part, r.before): r.rank for r in global_rank(df, "rank", -F.col("part"), F.col("before")).collect()}
    order = sorted(got, key=lambda k: (-k[0], k[1]))
    assert [got[k] for k in order] == list(range(1, 5001))
    assert global_rank(df.limit(0), "rank", F.col("part")).count() == 0


def test_spacer_whitelists_of_any_size(spark):
    """3,000 spacers of several lengths, some the beginnings of others, against a search place by place."""
    rng = random.Random(6)
    listed = sorted({"".join(rng.choices("ACGT", k=rng.choice((5, 6, 7)))) for _ in range(3000)} | {"ACGTA", "ACGTAC"})
    seqs = ["".join(rng.choices("ACGT", k=30)) for _ in range(40)] + ["", "ACGTACGTACGTAC", "AAAACTAGATTT", "[···TSO···]GGCTAGA", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string")
    white = spark.createDataFrame([(w,) for w in listed] + [(listed[0],), ("",)], "spacer string")

    def plain(s):
        first, out, at = None, "", 0
        while at < len(s):
            hit = next((w for n in (5, 6, 7) if (w := s[at : at + n]) in some and len(w) == n), None)
            first = first or hit
            out, at = (out + "[···WT···]", at + len(hit)) if hit else (out + s[at], at + 1)
        return first, out

    some = set(listed)
    for name, got in (("spacer", {r.id: r.spacer for r in ibars.extract_spacer(df, white).collect()}), ("seq", {r.id: r.seq for r in ibars.encode_wt(df, white).collect()})):
        assert len(got) == len(seqs)
        for i, s in enumerate(seqs[:-1]):
            first, out = plain(s)
            if name == "seq":
                assert got[i] == out
            elif first:
                assert got[i] == first
    assert ibars.extract_spacer(df, white.limit(0)).where("id = 42").first().spacer == "AAAA"


@pytest.mark.parametrize("local", [False, True])
@pytest.mark.parametrize("cells", [1, 50, 700])
def test_alignment_in_parts_is_the_whole_one(cells, local):
    """However little is held, the same operations come out, ties included; two letters make many ties."""
    rng = random.Random(cells)
    for _ in range(150):
        ref = "".join(rng.choices("AC", k=rng.randrange(0, 90)))
        seq = "".join(x for x in ref if rng.random() < 0.8) + "".join(rng.choices("AC", k=rng.randrange(0, 30)))
        whole, parts = align.align_pair(seq, ref, local), align.align_pair(seq, ref, local, cells=cells)
        assert whole == parts, (seq, ref)
        _, out_ref, out_seq, _, i, k = whole
        assert ref[i:].startswith(out_ref.replace("-", "")) and seq[k:].startswith(out_seq.replace("-", ""))


def test_alignment_of_long_pairs_in_little_memory():
    """12,000 letters against 11,700: 140 million cells, of which one million are held."""
    import tracemalloc

    rng = random.Random(8)
    ref = "".join(rng.choices("ACGT", k=12_000))
    seq = ref[:4000] + ref[4300:9000] + ref[9000:]
    tracemalloc.start()
    cigar, out_ref, out_seq, score, _, _ = align.align_pair(seq, ref, cells=1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cigar.count("D") == 1 and "300D" in cigar and out_ref == ref and out_seq.replace("-", "") == seq
    assert score == 5 * len(seq) - 20 - 299
    assert peak < 20_000_000


@pytest.mark.parametrize("map_bytes", [0, 1 << 20])
def test_barcodes_by_dictionary(spark, map_bytes):
    """As a map and by shuffle with dealt keys; a hot, a null and an unknown barcode, repeated entries, columns with the names of helpers."""
    rows = [("A" if i % 3 else ("B", "C", None)[i // 3 % 3], i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "bc string, raw int, part int")
    words = spark.createDataFrame([("A", "a2"), ("A", "a1"), ("B", "b"), (None, "n"), ("C", None)], "raw string, corrected string")
    got = dictionaries.correct_by_dictionary(df, words, "bc", "to", "NA", map_bytes=map_bytes, key_rows=20)
    assert got.columns == ["bc", "raw", "part", "to"]
    assert sorted(got.collect(), key=lambda r: r.raw) == [(b, i, p, {"A": "a1", "B": "b"}.get(b, "NA")) for b, i, p in rows]
    assert {r.to for r in dictionaries.correct_by_dictionary(df, words.limit(0), "bc", "to", map_bytes=map_bytes).collect()} == {None}
    assert dictionaries.correct_by_dictionary(df.limit(0), words, "bc", "to", map_bytes=map_bytes).count() == 0
    if map_bytes:
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_clone_pairs_of_chosen_cells_and_reads(spark):
    reads = spark.createDataFrame([("c1", "u", "X", 1), ("c1", "u", "Y", 2), ("c1", "u", "Z", 3), ("c1", "v", "Y", 4), ("c2", "u", "X", 5), ("c2", "v", "Z", 6), ("c3", "u", "X", 7), ("c3", "u", "Y", 8),
                                   (None, "u", "X", 9)], "cbc string, umi string, raw_ibar string, read int")

    def pairs(**options):
        return {(r.a, r.b): r.cells for r in ibars.clone_pairs(reads, **options).collect()}

    assert pairs() == {("X", "Y"): 2, ("X", "Z"): 2, ("Y", "Z"): 1}
    assert pairs(reads_per_umi=2, order="read") == {("X", "Y"): 2, ("X", "Z"): 1}
    assert pairs(top_cells=1) == {("X", "Y"): 1, ("X", "Z"): 1, ("Y", "Z"): 1}
    assert pairs(whitelist=spark.createDataFrame([("c3",), ("c3",), ("c9",)], "cbc string")) == {("X", "Y"): 1}


def test_unitigs_by_tables(spark):
    """The same texts as the walk in one task: random graphs with branches and ties, chains of every length, rings, loops, null and repeated groups."""
    rng = random.Random(5)
    rows = [("chain", "ACGTTGCATTGGATCCTTAA"), ("ring", "ACGTTGCAACGTTG"), ("loop", "AAAAAAAA"), ("two", "ACCGT"), ("two", "TTCAG"), (None, "ACGTAACC"), ("short", "AC"), ("both", "ACGGACGGA"), ("both", "CCCCCC")]
    rows += [(f"r{i}", "".join(rng.choices("ACGT"[: 2 + i % 3], k=rng.randrange(4, 40)))) for i in range(40) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "g string, r2_seq string")

    def contigs(bound):
        return {(r.g, r.k): r.contig for r in kmers.assembly_sweep(df, ["g"], [3, 5], [1], method="compression", task_edges=bound).collect()}

    task = contigs(1 << 30)
    assert len(task) == 94 and contigs(4) == task and contigs(0) == task
    assert task["loop", 5] == "AAAA" and task["short", 3] == ""


def test_unitig_of_a_long_molecule(spark):
    """More letters than several pieces; pointers need about 14 rounds."""
    text = "".join(random.Random(6).choices("ACGT", k=12_000))
    df = spark.createDataFrame([("m", text[i : i + 600]) for i in range(0, 12_000, 400)], "umi string, r2_seq string")
    got = kmers.assemble_umis(df, ["umi"], k=31, min_coverage=1, method="compression", task_edges=1000)
    assert got.first().contig == text


def test_groups_of_many_reads_are_assembled_by_tables(spark):
    """Groups above the bound, below it and a mix of both give the same contigs and the same most frequent read, null groups and null reads included."""
    rng = random.Random(8)
    text = "".join(rng.choices("ACGT", k=60))
    rows = [("a", text), ("a", text), ("a", text[:40] + "T" + text[41:]), (None, text[5:]), (None, text[5:]), ("n", None), ("s", "AC"), ("b", text[:20]), ("b", text[:18])]
    rows += [("many", text[i : i + 30]) for i in range(31)]
    df = spark.createDataFrame(rows, "g string, r2_seq string")
    for method in ("shortest_path", "compression"):
        def told(bound, method=method):
            return {(r.g, r.contig, r.raw) for r in kmers.assemble_umis(df, ["g"], k=9, min_coverage=1, method=method, start_anchor=text[:9], end_anchor=text[-9:], task_edges=bound, top="raw").collect()}

        few = told(1 << 30)
        assert len(few) == 6 and told(0) == few and told(100) == few
        assert ("n", "", None) in few and ("s", "", "AC") in few and {r for g, _, r in few if g == "a"} == {text}
        assert ("b", "" if method == "shortest_path" else text[:20], min(text[:18], text[:20])) in few


def test_kmers_of_small_groups_are_no_rows(spark):
    """The reads of a group are shuffled, not their k-mers."""
    df = spark.createDataFrame([(str(i % 5), "ACGTTGCATTGGATCCTTAA") for i in range(50)], "g string, r2_seq string")
    plan = kmers.assembly_sweep(df, ["g"], [5, 7], [1])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_trees_in_a_task_and_by_levels(spark):
    """Scores and permutations of trees folded whole are those of trees that go up level by level, null states, foreign leaves and several roots included."""
    from molspark.operators import trees

    rng = random.Random(9)
    edges, states = [], []
    for t in range(4):
        for i in range(2, 20 + t):
            edges.append((f"t{t}", f"n{i // 2}", f"n{i}"))
        edges += [(f"t{t}", "m1", "m2"), (f"t{t}", "m1", "m3"), (f"t{t}", "m1", "m4")]
        parents = {p for _, p, _ in edges[-30:]}
        leaves = [c for x, _, c in edges if x == f"t{t}" and c not in parents]
        states += [(f"t{t}", s, leaf, rng.choice([None, -1, 0, 1, 2, 70])) for s in "ab" for leaf in [*leaves, "foreign"] if rng.random() < 0.9]
    e = spark.createDataFrame(edges, "tree_id string, parent string, child string")
    s = spark.createDataFrame(states, "tree_id string, site string, leaf string, state int")
    key = lambda rows: {(r.tree_id, r.site): tuple(round(x, 9) if isinstance(x, float) else x for x in r[2:]) for r in rows}
    scores = key(trees.parsimony_score(e, s).collect())
    assert len(scores) == 8 and key(trees.parsimony_score(e, s, tree_edges=0).collect()) == scores == key(trees.parsimony_score(e, s, tree_edges=22).collect())
    null = key(trees.parsimony_null(e, s, 20).collect())
    assert {k: v[0] for k, v in null.items()} == {k: v[0] for k, v in scores.items()}
    by_levels = {(r.tree_id, r.site): r for r in trees.parsimony_null(e, s, 20, tree_edges=0).collect()}
    assert {k: tuple(round(by_levels[k][c], 9) if isinstance(by_levels[k][c], float) else by_levels[k][c] for c in ("observed", "null_mean", "null_sd", "p", "z")) for k in null} == null


def test_neighbours_by_one_letter_meet_in_small_groups(spark):
    """All barcodes of a dense set find the best one within a substitution, and no pairs of a shared half are made."""
    import itertools

    rng = random.Random(4)
    words = ["".join(w) for w in itertools.product("ACGT", repeat=4)] + ["AC", "AG", "N", "", "ACGTA", "ÄCGT"]
    counts = {w: rng.randrange(1, 6) for w in words}
    df = spark.createDataFrame(list(counts.items()), "umi string, reads long")
    merged = umi.barcode_merge(df, 1)
    want = {w: max((v for v in words if len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) <= 1), key=lambda v: (counts[v], v.encode())) for w in words}
    assert {r.old: r.new for r in merged.collect()} == want
    assert "levenshtein" not in (plan := merged._jdf.queryExecution().optimizedPlan().toString()) and "piece" not in plan


def test_quality_background_is_summed_before_the_shuffle(spark):
    df = spark.createDataFrame([("!5I",), ("I5",), (None,), ("",), ("5",)], "qual string")
    got = reads.quality_background_quantile(df, "qual", 0.5)
    assert {(r.pos, r.q) for r in got.collect()} == {(0, 20.0), (1, 20.0), (2, 40.0)}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 2 and "percentile(v" in text


def test_lineage_vectors_are_coded_in_time_of_their_length(spark):
    from molspark.operators import alleles

    n = 20_000
    df = spark.createDataFrame([("ACGT" * n, "ACGT" * n), (None, "ACGT"), ("ACGT", None), ("ACGT", "")], "aligned_ref string, aligned_seq string")
    got = alleles.lineage_vector(df, [("a", 0, 2), ("b", 3, 3)], "AC", "GT", anchor_errors=0)
    assert [r.barcode for r in got.collect()] == ["..|..", "..|..", "..|..", "trash-unmatched"]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
