"""Queries that SQL can't express, over the whole small fixture against plain Python, and options on hand-made cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from molspark.functions import approximate
from molspark.functions import sequence as s
from molspark.operators import align, alleles, cassette, kmers, qc, reads, trees, umi
from molspark.operators.pairs import pairs_in_groups
from molspark.operators.umi import umi_correct, umi_dominant_seq
from molspark.plans.constants import END, METAS, START
from molspark.plans.fixtures import fixture
from molspark.plans.queries import ORACLE_SQL, QUERIES
from molspark.sources.shared import drop_stored, materialise, session_folder, shared_dir

TESTED = {"assemble_umis", "assembly_sweep", "assembly_optimize", "contig_table", "assemble_segmented", "align_alleles", "bin_alleles", "parsimony_score", "parsimony_null", "tree_qc_summary", "knee_threshold_kmeans"}


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(ORACLE_SQL) == TESTED


def plain_contig(seqs, k, coverage, start, end):
    """The walk of fewest steps from the start to the end anchor's node, level by level, ties by coverage, then text."""
    count = Counter()
    for x in seqs:
        x = x[x.find(start) :] if start in x else x
        x = x[: x.find(end) + len(end)] if end in x else x
        count.update(x[i : i + k] for i in range(len(x) - k + 1))
    edges = {kmer: n for kmer, n in count.items() if n >= coverage}
    nodes = sorted({e[:-1] for e in edges} | {e[1:] for e in edges})
    first = next((n for n in nodes if n.startswith(start[: k - 1])), None)
    last = next((n for n in nodes if n.endswith(end[-(k - 1) :])), None)
    if first is None or last is None:
        return ""
    seen, level = set(), {first: (0, first)}
    while level:
        if last in level:
            return level[last][1]
        seen |= set(level)
        after = {}
        for node, (cost, text) in level.items():
            for c in "ACGT":
                if (n := edges.get(node + c)) and (node + c)[1:] not in seen:
                    new = (cost - n, text + c)
                    after[(node + c)[1:]] = min(after.get((node + c)[1:], new), new)
        level = after
    return ""


@pytest.fixture(scope="module")
def fx_reads(spark, small):
    return [(r.read_id, r.r1_seq, r.r2_seq) for r in fixture(spark, small, "fx_reads").collect()]


def test_assembly(spark, small, fx_reads):
    by, pairs = defaultdict(list), defaultdict(list)
    for _, r1, r2 in fx_reads:
        by[r1[:12]].append(r2)
        pairs[r1[:12], r1[12:18]].append(r2)
    one = {(u, b): plain_contig(x, 15, 2, START, END) for (u, b), x in pairs.items()}
    assert {(r.umi, r.sbc): r.contig for r in QUERIES["assemble_umis"](spark, small).collect()} == one
    table = {(r.umi, r.sbc): (r.contig, r.reads, r.length, r.sample_id) for r in QUERIES["contig_table"](spark, small).collect()}
    assert table == {u: (c, len(pairs[u]), len(c), "s1") for u, c in one.items() if len(pairs[u]) >= 3}
    grid = {(u, k, c): plain_contig(x, k, c, START, END) for u, x in by.items() for k in (13, 17) for c in (1, 2)}
    assert {(r.umi, r.k, r.min_coverage): r.contig for r in QUERIES["assembly_sweep"](spark, small).collect()} == grid
    best = {u: max((START in grid[u, k, c] and END in grid[u, k, c], len(grid[u, k, c]), -k, -c, grid[u, k, c]) for k in (13, 17) for c in (1, 2)) for u in by}
    assert {r.umi: (r.contig, r.k, r.min_coverage, r.failed) for r in QUERIES["assembly_optimize"](spark, small).collect()} == {u: (b[4], -b[2], -b[3], not b[4]) for u, b in best.items()}
    some = spark.createDataFrame([(u, x) for u, xs in by.items() for x in xs], "umi string, seq string")
    kept = kmers.assembly_optimize(some, ["umi"], [13], [1], seq="seq", start_anchor=START, end_anchor=END, min_reads=2)
    assert {r.umi for r in kept.collect()} == {u for u, x in by.items() if len(x) >= 2}


def test_segmented_assembly_rebuilds_clean_molecules(spark, small, fx_reads):
    """A molecule of equal reads that hold each META once is stitched to its read between the cassette's ends."""
    by = defaultdict(list)
    for _, r1, r2 in fx_reads:
        by[r1[:12]].append(r2)
    rows = {r.umi: r for r in QUERIES["assemble_segmented"](spark, small).collect()}
    clean = {u: x[0] for u, x in by.items() if len(x) >= 2 and len(set(x)) == 1 and all(x[0].count(m) == 1 for m in METAS.values()) and x[0].count(START) == 1 and x[0].count(END) == 1}
    assert clean or rows
    for u, x in clean.items():
        assert rows[u].stitched_seq == x[x.index(START) : x.index(END) + len(END)]


def plain_score(seq, ref):
    """Affine global score with free gaps at the start, cell by cell."""
    low = -(10**9)
    h = [[0] * (len(seq) + 1) for _ in range(len(ref) + 1)]
    e, f = ([[low] * (len(seq) + 1) for _ in range(len(ref) + 1)] for _ in range(2))
    for i in range(1, len(ref) + 1):
        for j in range(len(seq) + 1):
            e[i][j] = max(h[i - 1][j] - 20, e[i - 1][j] - 1)
            if j:
                f[i][j] = max(h[i][j - 1] - 20, f[i][j - 1] - 1)
                h[i][j] = max(h[i - 1][j - 1] + (5 if ref[i - 1] == seq[j - 1] else -4), e[i][j], f[i][j])
    return h[-1][-1]


def cigar_of(a, b):
    return "".join(f"{len(m[0])}{m[0][0]}" for m in re.finditer(r"M+|I+|D+", "".join("I" if x == "-" else "D" if y == "-" else "M" for x, y in zip(a, b, strict=True))))


def test_align_alleles(spark, small):
    guides = [r.seq for r in fixture(spark, small, "fx_guides").collect()]
    start, end = re.compile(s.fuzzy_pattern("ATGGG")), s.fuzzy_pattern("GGGTTAG")
    by = defaultdict(Counter)
    wild = defaultdict(Counter)
    for g in guides:
        ibar = (re.search("CTAGA(.{6})AATAGCAA", g) or [None, ""])[1]
        if m := re.search(f"(?:{start.pattern}).*?(?:{end})", g):
            by[ibar][m[0]] += 1
            w = re.search("GGG(.*?)GGGTTAG", g)
            if w and len(w[1]) == 20:
                wild[ibar][m[0]] += 1
    want = Counter()
    for ibar, cut in by.items():
        if sum(cut.values()) >= 5 and wild[ibar]:
            ref = min(wild[ibar], key=lambda x: (-wild[ibar][x], x))
            for x, n in cut.items():
                want[ibar, ref, x] += n
    rows = QUERIES["align_alleles"](spark, small).collect()
    assert Counter((r.raw_ibar, r.ref, r.seq) for r in rows) == want
    for x, ref, cigar, score in {(r.seq, r.ref, r.cigar_str, r.alignment_score) for r in rows}:
        _, a, b, _, _, _ = align.align_pair(x, ref)
        assert a.replace("-", "") == ref and b.replace("-", "") == x and cigar == cigar_of(a, b) and score == plain_score(x, ref)


def test_local_alignment(spark):
    core = "ACGTTGCAAGGCTTACGA"
    cigar, a, b, score, at_ref, at_seq = align.align_pair("TTTTT" + core + "GG", "CCCCCCCC" + core[:9] + core[9:] + "AAAA", local=True)
    assert (a, b, cigar, score, at_ref, at_seq) == (core, core, "18M", 90, 8, 5)
    assert align.align_pair("AAAA", "CCCC", local=True)[:4] == ("", "", "", 0)
    rng = random.Random(2)
    for _ in range(60):
        x, y = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 16))) for _ in range(2))
        _, a, b, score, i, j = align.align_pair(x, y, local=True)
        best = max((plain_local(x[p:], y[q:]) for p in range(len(x)) for q in range(len(y))), default=0)
        assert score == max(best, 0) and y[i : i + len(a.replace("-", ""))] == a.replace("-", "") and x[j : j + len(b.replace("-", ""))] == b.replace("-", "")
    pairs = spark.createDataFrame([("TTT" + core, core)], "seq string, ref string")
    assert align.align_distinct(pairs, local=True).first().start_seq == 3


def plain_local(x, y):
    """The best score of beginnings of both, gaps priced, cell by cell."""
    low = -(10**9)
    h = {(0, 0): 0}
    e, f = {}, {}
    for i in range(len(y) + 1):
        for j in range(len(x) + 1):
            e[i, j] = max(h[i - 1, j] - 20, e[i - 1, j] - 1) if i else low
            f[i, j] = max(h[i, j - 1] - 20, f[i, j - 1] - 1) if j else low
            if i or j:
                h[i, j] = max(e[i, j], f[i, j], h[i - 1, j - 1] + (5 if y[i - 1] == x[j - 1] else -4) if i and j else low)
    return max(h.values())


def plain_vector(a, b, bins, anchor, tail, errors=0):
    """Interval codes by a walk over the columns."""
    at, end = b.find(anchor), tail in b
    if at < 0 and not end:
        return "trash-unmatched"
    events, r = [], -1
    for x, y in zip(a[max(at, 0) :].upper(), b[max(at, 0) :].upper(), strict=True):
        if x == "-":
            events.append((max(r, 0), "i", y))
        else:
            r += 1
            events.append((r, "=" if x == y else "d" if y == "-" else "m", x if y == "-" else y))
    run = "".join({"i": c, "d": c.lower()}.get(k, ".") for p, k, c in events if bins[0][1] <= p <= bins[-1][2])
    if re.search("A{8}|G{8}|a{8}|g{8}", run):
        return "trash-gen"
    out = []
    for _, first, last in bins:
        n = Counter(k for p, k, _ in events if first <= p <= last)
        out.append(".NA." if n["m"] > 50 else "..exx" if n["d"] == last - first + 1 else ".".join(str(n[k]) if n[k] else "" for k in "mid"))
    if not end:
        out = [".NA." if c == "..exx" else c for c in out]
        out[-1] = out[-1] if out[-1] == ".." else ".NA."
    return "|".join(out)


def test_bin_alleles(spark, small, fx_reads):
    ref, bins = "CATCTTAGTCATTACGACAGGTGTTCGTTG", [("left", 0, 12), ("cut", 13, 17), ("right", 18, 29)]
    cut = [(r1[:12], (re.search("(CATCTTAGTCATTAC.*GACAGGTGTTCGTTG)", r2) or [None, ""])[1]) for _, r1, r2 in fx_reads]
    molecules = umi_dominant_seq(umi_correct(spark.createDataFrame(cut, "umi string, seq string"), 1)).where("reads_per_umi >= 2").collect()
    want = {}
    for m in molecules:
        cigar, a, b, score, _, _ = align.align_pair(m.dominant_seq, ref)
        want[m.umi] = (m.reads_per_umi, cigar, score, plain_vector(a, b, bins, "CATCTTAG", "TGTTCGTTG"))
    assert {r.umi: (r.reads, r.cigar_str, r.alignment_score, r.barcode) for r in QUERIES["bin_alleles"](spark, small).collect()} == want


def test_lineage_vector_options(spark):
    bins = [("b1", 6, 9), ("b2", 10, 13), ("b3", 14, 17)]
    ref = "ACGTGGAAAACCCCTTTTGGCATT"
    rows = [(0, ref, ref), (1, ref, "ACGAGG" + ref[6:]), (2, ref, "TTTTTT" + ref[6:18] + "AAAAAA"), (3, ref, ref[:6] + "----" + ref[10:])]
    df = spark.createDataFrame(rows, "i int, aligned_ref string, aligned_seq string")

    def codes(**options):
        return {r.i: r.barcode for r in alleles.lineage_vector(df, bins, "ACGTGG", "GGCATT", **options).collect()}

    assert codes(anchor_errors=1) == {0: "..|..|..", 1: "..|..|..", 2: "trash-unmatched", 3: "..exx|..|.."}
    assert codes(anchor_errors=0, read_end="read1", read_length=11)[0] == "..|.NA.|.NA." and codes(anchor_errors=0, read_end="read2", read_length=12)[0] == ".NA.|.NA.|.."
    long = spark.createDataFrame([("AC" + "-" * 8 + "GTTT", "AC" + "A" * 8 + "GTTT")], "aligned_ref string, aligned_seq string")
    assert alleles.lineage_vector(long, [("b", 0, 5)], "AC", "GTTT", anchor_errors=0).first().barcode == "trash-gen"


def test_approximate_places(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 30))),) for _ in range(200)] + [("TTACGTGGTT",), ("TTACGGTT",)]
    for errors in (0, 1, 2):
        for r in spark.createDataFrame(rows, "x string").select("x", approximate.approx_place(F.col("x"), "ACGTGG", errors).alias("at")).collect():
            want = next((p + 1 for p in range(len(r.x)) for n in range(6 - errors, 7 + errors) if p + n <= len(r.x) and edits(r.x[p : p + n], "ACGTGG") <= errors), 0)
            assert r["at"] == want, (r.x, errors)


def _ends(seq, text, errors):
    """Ends of near stretches by the plain table of distances, free to start anywhere."""
    row, out = list(range(len(text) + 1)), []
    for at, c in enumerate(seq, 1):
        row, old = [0], row
        for j, y in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != y)))
        if row[-1] <= errors:
            out.append(at)
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 63, 64, 65, 130])
def test_ends_by_bit_vectors(size):
    """At and around a word's length; empty, long and odd sequences among short ones."""
    rng = random.Random(size)
    text = "".join(rng.choices("ACGT", k=size))
    seqs = ["", "\0", "A", text, text[1:], "é" + text + "\0", text[: size // 2] + "G" + text[size // 2 :], "AC" * 300 + text + "x"]
    seqs += ["".join(rng.choices("ACGTN", k=rng.randrange(40))) + text[rng.randrange(3) :] + "".join(rng.choices("ACGT", k=rng.randrange(9))) for _ in range(30)]
    for errors in (0, 1, 3, size):
        assert approximate.ends_within(seqs, text, errors) == [_ends(s, text, errors) for s in seqs]
    assert approximate.ends_within([], text, 1) == []


def test_anchors_by_windows(spark):
    """Windows of the anchors' own lengths, each measured alone; null and empty reads, a column named like a helper."""
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng, one, two = random.Random(8), "ACGTGGA", "TTGCAC"
    reads_ = [None, "", one + two] + ["".join(rng.choices("ACGT", k=rng.randrange(6))) + one[: rng.randrange(5, 8)] + "".join(rng.choices("ACGT", k=rng.randrange(3, 6))) + two[rng.randrange(2) :] + "G" * rng.randrange(4) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(reads_)), "best int, x string")
    got = {r.best: (r.barcode, r.edits) for r in reads.approx_anchor_extract(df, "x", one, 2, 4, two, 1).collect()}
    for i, x in enumerate(reads_):
        found = [(edits(x[p - 7 : p], one) + edits(x[p + 4 : p + 10], two), p) for p in range(7, len(x or "") - 9) if edits(x[p - 7 : p], one) <= 2 and edits(x[p + 4 : p + 10], two) <= 1]
        assert got[i] == ((x[min(found)[1] :][:4], min(found)[0]) if found else (None, None)), x


def fitch(node, kids, leaves):
    if node not in kids:
        return ({leaves[node]} if leaves.get(node, -1) >= 0 else set()), 0
    at, n = set(), 0
    for k in sorted(kids[node]):
        found, m = fitch(k, kids, leaves)
        n += m
        if found:
            at, n = (found, n) if not at else (at & found, n) if at & found else (at | found, n + 1)
    return at, n


def test_parsimony(spark, small):
    """Scores, null statistics of stated permutations, and the summary, of all trees of the fixture."""
    edges, states = fixture(spark, small, "fx_tree_edges"), fixture(spark, small, "fx_tree_alleles")
    kids, cells = defaultdict(lambda: defaultdict(list)), defaultdict(dict)
    for e in edges.collect():
        kids[e.tree_id][e.parent].append(e.child)
    for r in states.collect():
        cells[r.tree_id, r.site][r.leaf] = r.state
    roots = {t: [p for p in k if all(p not in c for c in k.values())] for t, k in kids.items()}

    def score(tree, leaves):
        return sum(fitch(r, kids[tree], leaves)[1] for r in roots[tree])

    want = {(t, site): score(t, x) for (t, site), x in cells.items() if t in roots}
    assert {(r.tree_id, r.site): r.score for r in QUERIES["parsimony_score"](spark, small).collect()} == want
    n, stats = 12, {}
    for (t, site), x in cells.items():
        if t in roots:
            leaves = sorted(x)
            null = []
            for perm in range(1, n + 1):
                mixed = sorted(leaves, key=lambda leaf: (hashlib.md5(f"0:{perm}:{leaf}".encode()).hexdigest(), leaf))
                null.append(score(t, {leaf: x[m] for leaf, m in zip(leaves, mixed, strict=True)}))
            sd = float(stdev(null))
            stats[t, site] = (want[t, site], float(mean(null)), float(sd), (want[t, site] - mean(null)) / sd if sd else None, (1 + sum(v <= want[t, site] for v in null)) / (n + 1))
    got = trees.parsimony_null(edges, states, n).collect()
    near = pytest.approx
    assert {(r.tree_id, r.site): (r.observed, near(r.null_mean), near(r.null_sd, abs=1e-9), r.z if r.z is None else near(r.z), near(r.p)) for r in got} == stats
    table = spark.createDataFrame([(*k, *v) for k, v in stats.items()], "tree_id string, site string, observed long, null_mean double, null_sd double, z double, p double")
    several = {k for k, x in cells.items() if len({v for v in x.values() if v >= 0}) > 1}
    for r in trees.tree_qc_summary(table, states).collect():
        z = [v[3] for k, v in stats.items() if k[0] == r.tree_id and k in several and v[3] is not None]
        assert r.analysed == sum(k[0] == r.tree_id for k in several)
        if z:
            assert r.mean_z == near(mean(z)) and r.quality == ("good" if mean(z) < -2 else "moderate" if mean(z) < -1 else "poor")


def test_two_means_part_noise_from_signal(spark):
    counts = [1] * 300 + [2] * 100 + [200] * 40 + [300] * 20
    df = spark.createDataFrame([(f"u{i}",) for i, n in enumerate(counts) for _ in range(n)], "umi string")
    cut = qc.knee_threshold(df, method="kmeans").first().threshold
    assert 2 < cut < 200 and abs(cut - 400**0.5) < 1e-6
    assert qc.knee_threshold(df, method="drop").first().threshold == 2 and qc.knee_threshold(df.where("umi = 'u0'"), method="drop").first().threshold == 1
    with pytest.raises(ValueError):
        qc.knee_threshold(df, method="other")


def test_experiments_need_one_batch_a_sample(spark):
    mols = spark.createDataFrame([("c", "u", "b", "s1"), ("c", "v", "b", "s2")], "cbc string, umi string, raw_ibar string, sample_id string")
    fine = spark.createDataFrame([("s1", "1"), ("s2", "2"), ("s2", "2")], "sample_id string, batch string")
    assert reads.ingest_experiments([mols], fine, None, 1).count() == 2
    for bad in ([("s1", "1"), ("s1", "2")], [("s1", "1"), ("s2", "1")]):
        with pytest.raises(ValueError):
            reads.ingest_experiments([mols], spark.createDataFrame(bad, "sample_id string, batch string"), None, 1)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_in_groups(spark, block):
    """Blocks of any size give each pair once."""
    rows = [("hot", i) for i in range(20)] + [("a", 1), ("a", 2), ("one", 5), (None, 1), (None, 2)]
    got = Counter((r.k, r.x, r.y) for r in pairs_in_groups(spark.createDataFrame(rows, "k string, i int"), ["k"], "i", {"i": "x"}, {"i": "y"}, block).collect())
    assert got == Counter((k, i, j) for k, i in rows for q, j in rows if k is not None and k == q and i < j)


def test_head_of_each_file(spark, tmp_path):
    for name in "ab":
        spark.range(20).selectExpr("id", f"'{name}' as name").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got = reads.head_per_file(spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b"), 3, "id").collect()
    assert sorted((r.name, r.id) for r in got) == [(n, i) for n in "ab" for i in range(3)] and len({r.file for r in got}) == 2


def test_stored_tables_are_dropped(spark, tmp_path_factory):
    """All of the application's stored tables go at once; it may store new ones."""
    from pathlib import Path

    kept = materialise(spark.range(3), "kept")
    assert kept.count() == 3 and Path(session_folder(spark)).is_dir()
    drop_stored(spark)
    assert not Path(session_folder(spark)).exists() and materialise(spark.range(3), "new").count() == 3


def test_shared_folder_is_the_one_that_is_named(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_chains_of_any_length_are_followed(spark):
    """Roots of a merge chain, and the pairs that a coverage bound keeps."""
    chain = spark.createDataFrame([(f"b{i:02}", f"b{max(i - 1, 0):02}") for i in range(40)], "old string, new string")
    assert {r.new for r in umi.merge_roots(chain).collect()} == {"b00"}
    assert cassette.boundary_kmers({"m": "x"}, "a", "b") == {"m": "x", "_CASSETTE_START_": "a", "_CASSETTE_END_": "b"}
