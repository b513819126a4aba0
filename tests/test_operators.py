"""Hand-made cases and invariants of the operators."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from molspark.functions import sequence as s
from molspark.operators import align, cassette, kmers, reads, trees, umi
from molspark.plans.constants import EDITED, END, METAS, START


@given(st.text("ACGTN", max_size=40))
def test_reverse_complement_twice(seq):
    assert s.reverse_complement_text(s.reverse_complement_text(seq)) == seq


def test_fuzzy_regex_equals_fuzzy_pattern(spark):
    """The same hits, one after the other, in random strings that hold pieces of the text; and the guards let no inexact hit pass."""
    import random
    import re

    rng = random.Random(1)
    rows = []
    for text in ("ACGTACGTTGCA", "AATAGCAA", "GGGTTAGAG", "AAAA", "AC", "A", "TATGGGTATGGG"):
        for wildcard in (".{0,1}", ".{0,4}"):
            flat, nested = re.compile(s.fuzzy_pattern(text, wildcard)), re.compile(s.fuzzy_regex(text, wildcard))
            for _ in range(300):
                seq = "".join(rng.choice(["A", "C", "G", "T", text, text[: len(text) // 2], text[1:], text[:-1], text[:2] + "C" + text[3:], text + text[-1:]]) for _ in range(rng.randrange(1, 9)))
                assert flat.sub("<>", seq) == nested.sub("<>", seq) and [m.span() for m in flat.finditer(seq)] == [m.span() for m in nested.finditer(seq)]
                rows.append((text, wildcard, seq, flat.sub(text, seq), bool(flat.search(seq))))
    for text, wildcard in {(r[0], r[1]) for r in rows}:
        some = spark.createDataFrame([r[2:] for r in rows if r[:2] == (text, wildcard)], "seq string, want string, has boolean")
        bad = some.where((s.sanitize(F.col("seq"), text, wildcard) != F.col("want")) | (s.has_fuzzy(F.col("seq"), text, wildcard) != F.col("has"))) if len(text) > 3 else some.limit(0)
        assert bad.count() == 0, (text, wildcard, bad.first())


def test_fuzzy_pattern():
    assert s.fuzzy_pattern("ACG") == "ACG|.{0,1}CG|A.{0,1}G|AC.{0,1}"
    assert s.fuzzy_pattern("A" * 201) == "A" * 201
    assert s.fuzzy_pattern("") == ""


def test_scramble_is_the_same_on_both_sides(spark):
    row = spark.createDataFrame([("seed", "ACGTTGCAAC")], "k string, v string").select(s.dna_scramble(F.col("k"), F.col("v"))).first()
    assert row[0] == s.scramble_text("seed", "ACGTTGCAAC") and sorted(row[0]) == sorted("ACGTTGCAAC")


def test_replace_first_and_extract_or_null(spark):
    df = spark.createDataFrame([("aXbXc",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(s.replace_first(F.col("v"), "X", "-")).collect()] == ["a-bXc", "abc", None]
    assert [r[0] for r in df.select(s.extract_or_null(F.col("v"), "a(X?)b", 1)).collect()] == ["X", "", None]


def test_mask_round_trip(spark):
    df = spark.createDataFrame([("GG" + METAS["META01"] + "CATCTTAGTCATTACACTGTGACAGGTGTTCGTTG" + METAS["META02"] + "TT",)], "v string")
    masked = cassette.mask_flanks(df, METAS, EDITED, "v")
    assert masked.first()[0] != df.first()[0] and "ACTGT" in masked.first()[0]
    assert cassette.unmask_flanks(masked, METAS, EDITED, "v").first()[0] == df.first()[0]


def test_stitching_error_free_segments_rebuilds_the_cassette(spark):
    read = START + "AAAA" + METAS["META01"] + "CCCC" + METAS["META02"] + "GGGG" + METAS["META03"] + "TT" + END
    df = spark.createDataFrame([("u1", read), ("u2", "ACGT"), ("u3", None)], "umi string, seq string")
    segments = cassette.segment_by_metas(df, METAS, START, END, "seq", ["umi"])
    assert segments.count() == 4
    assert cassette.stitch_segments(segments, list(METAS), ["umi"]).collect() == [("u1", read)]


def test_umi_correct_follows_chains(spark):
    rows = ["AAAA"] * 5 + ["AAAC"] * 3 + ["AACC"] * 1 + ["GGGG"]
    df = spark.createDataFrame([(x,) for x in rows], "umi string")
    assert sorted(r[0] for r in umi.umi_correct(df, 1).collect()) == ["AAAA"] * 9 + ["GGGG"]
    one_hop = dict(umi.barcode_merge(df.groupBy("umi").agg(F.count("*").alias("reads")), 1).collect())
    assert one_hop == {"AAAA": "AAAA", "AAAC": "AAAA", "AACC": "AAAC", "GGGG": "GGGG"}
    by_edits = dict(umi.barcode_merge(spark.createDataFrame([("ACGTACGT", 5), ("CGTACGT", 2), ("TTTTTTTT", 1)], "umi string, reads long"), 1, "regex").collect())
    assert by_edits == {"ACGTACGT": "ACGTACGT", "CGTACGT": "ACGTACGT", "TTTTTTTT": "TTTTTTTT"}


def test_assembly_rebuilds_the_template(spark):
    rng = random.Random(3)
    template = "ACGTTGCATT" + "".join(rng.choice("ACGT") for _ in range(60)) + "GGATCCTTAA"
    parts = [template[i : i + 40] for i in range(0, 41, 4)] * 3
    df = spark.createDataFrame([("u", x) for x in parts] + [("none", "ACG")], "umi string, r2_seq string")
    out = dict(kmers.assemble_umis(df, ["umi"], k=13, min_coverage=2, start_anchor="ACGTTGCATT", end_anchor="GGATCCTTAA").collect())
    assert out == {"u": template, "none": ""}
    longest = kmers.assemble_umis(df, ["umi"], k=13, min_coverage=2, method="compression").where("umi = 'u'").first()
    assert longest.contig == template


@settings(deadline=None, max_examples=60)
@given(st.text("ACGT", min_size=1, max_size=25), st.text("ACGT", min_size=1, max_size=25))
def test_alignment_holds_both_sequences(seq, ref):
    cigar, a, b, score = align.align_pair(seq, ref)[:4]
    assert a.replace("-", "") == ref and b.replace("-", "") == seq and len(a) == len(b)
    assert "".join(str(c) for c in cigar) and score <= 5 * min(len(seq), len(ref))


def test_alignment_of_a_deletion():
    cigar, a, b, score = align.align_pair("ACGTACGTAAGGCCTT" * 2, "ACGTACGTAAGGCCTT" + "TTTTT" + "ACGTACGTAAGGCCTT")[:4]
    assert re.fullmatch(r"(14|15|16)M5D(18|17|16)M", cigar)  # the two Ts before the gap may stand on either side
    assert score == 32 * 5 - 24


def test_parsimony_against_a_plain_fold(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("b", "f"), ("b", "g")]
    rng = random.Random(1)
    states = [(tree, "s", leaf, rng.choice([-1, 0, 1, 2])) for tree in ("t1", "t2", "t3", "t4") for leaf in "cdefg"]

    def fitch(node, leaves):
        kids = sorted(c for p, c in edges if p == node)
        if not kids:
            return ({leaves[node]} if leaves[node] >= 0 else set()), 0
        at, n = set(), 0
        for k in kids:
            s, m = fitch(k, leaves)
            n += m
            if s:
                at, n = (s, n) if not at else (at & s, n) if at & s else (at | s, n + 1)
        return at, n

    got = {r.tree_id: r.score for r in trees.parsimony_score(spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame(states, "tree_id string, site string, leaf string, state int")).collect()}
    assert got == {t: fitch("r", {leaf: v for tree, _, leaf, v in states if tree == t})[1] for t in got} and len(got) == 4


def test_null_scores_are_probabilities(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("b", "f")], "parent string, child string")
    states = spark.createDataFrame([("t", "s", leaf, i // 2) for i, leaf in enumerate("cdef")], "tree_id string, site string, leaf string, state int")
    row = trees.parsimony_null(edges, states, 30).first()
    assert row.observed == 1 and 0 < row.p <= 1


@pytest.mark.parametrize("anchor_errors", [0, 1, 2])
def test_approximate_anchors(spark, anchor_errors):
    df = spark.createDataFrame([("TTGAGACTGCATGGACGTACGTAGAAGCCGTG",), ("TTGAGACTCCATGGACGTACGTAGAAGCCGTG",), ("ACGT",), (None,)], "v string")
    got = [r.barcode for r in reads.approx_anchor_extract(df, "v", START, anchor_errors, 8, "AGAAGCCGTG", 0).collect()]
    assert got == ["ACGTACGT", "ACGTACGT" if anchor_errors else None, None, None]


def test_parse_reads_of_no_rows(spark):
    df = spark.createDataFrame([], "read_id string, r1_seq string")
    assert reads.parse_reads(df, 12, "GGCAC").count() == 0


def test_streaming_equals_batch(spark, small, tmp_path):
    from molspark.plans.fixtures import fixture
    from molspark.streaming import read_stream, write_stream

    folder = str(tmp_path / "in")
    fixture(spark, small, "fx_long").write.parquet(folder)
    batch = reads.orient_reads(spark.read.parquet(folder), START)
    stream = read_stream(spark, folder, "name string, sequence string, quality_scores string")
    write_stream(reads.orient_reads(stream, START), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).isEmpty()


def test_barcodes_and_segments_of_a_stream(spark, small, tmp_path):
    """Row-local operators in a row, on arriving files, give what a batch gives."""
    from molspark.plans.fixtures import fixture
    from molspark.streaming import read_stream, write_stream

    def steps(df):
        parsed = reads.parse_barcodes(df, 12, "GGCACACTGTCCT").where("ont and valid_umi")
        return cassette.segment_by_metas(parsed, METAS, START, END, "r2_seq", ["umi", "sbc"])

    folder = str(tmp_path / "in")
    fixture(spark, small, "fx_reads").write.parquet(folder)
    stream = read_stream(spark, folder, "read_id string, r1_seq string, r2_seq string")
    write_stream(steps(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), steps(spark.read.parquet(folder))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0


def test_trees_grow_with_the_tables(spark):
    from molspark.plans.fixtures import fixture
    from molspark.plans.queries import QUERIES

    for folder, customers in (("/root/testdata/sf0.001", 150), ("/root/testdata/sf0.01", 1500)):
        states, edges = (fixture(spark, folder, v) for v in ("fx_tree_alleles", "fx_tree_edges"))
        trees_ = -(-customers // 64)
        assert edges.select("tree_id").distinct().count() == trees_
        assert edges.where("cast(substr(child, 2) as int) >= 64").count() == customers
        known = states.where("state >= 0").count()
        assert known > 0.6 * 6 * customers
        scores = QUERIES["parsimony_score"](spark, folder)
        assert scores.count() == 6 * trees_ and scores.where("score > 0").count() == 6 * trees_


def test_parsimony_of_a_tree_each(spark):
    edges = spark.createDataFrame([("t1", "r", "a"), ("t1", "r", "b"), ("t2", "r", "a"), ("t2", "r", "x"), ("t2", "x", "b"), ("t2", "x", "c")], "tree_id string, parent string, child string")
    states = spark.createDataFrame([("t1", "s", "a", 0), ("t1", "s", "b", 0), ("t2", "s", "a", 0), ("t2", "s", "b", 1), ("t2", "s", "c", 2)], "tree_id string, site string, leaf string, state int")
    assert {(r.tree_id, r.score) for r in trees.parsimony_score(edges, states).collect()} == {("t1", 0), ("t2", 2)}


def test_allele_matrix_holds_every_site(spark, small):
    from molspark.plans.fixtures import fixture
    from molspark.plans.queries import QUERIES

    mols = fixture(spark, small, "fx_mols")
    got = QUERIES["allele_matrix_long"](spark, small)
    cells, sites, known = mols.select("cbc").distinct().count(), mols.select("raw_ibar").distinct().count(), mols.select("cbc", "raw_ibar").distinct().count()
    assert sites > 3 and got.select("site").distinct().count() == sites
    assert got.count() == cells * sites and got.where("allele <> 'NA'").count() == known


@pytest.mark.parametrize("name", ["parsimony_null", "tree_qc_summary"])
def test_null_queries_draw_all_permutations(spark, small, name, monkeypatch):
    from molspark.plans.queries import QUERIES

    drawn = []
    real = trees.parsimony_null

    def seen(edges, states, n=1000, seed=0):
        drawn.append(n)
        return real(edges, states.where("tree_id = 't0' and site = 'r1'"), 3, seed)

    monkeypatch.setattr(trees, "parsimony_null", seen)
    QUERIES[name](spark, small)
    assert drawn == [1000]


def test_sample_sheet_and_erosion_read_all_rows(spark, small):
    from molspark.plans.fixtures import fixture
    from molspark.plans.queries import QUERIES

    primers = fixture(spark, small, "fx_plates")
    sheet = QUERIES["sample_sheet_plates"](spark, small)
    ids = sheet.select("i5_id").distinct().count() + sheet.select("i7_id").distinct().count()
    assert ids == primers.count() == spark.read.parquet(f"{small}/part.parquet").count()
    erosion = QUERIES["profile_erosion_lines"](spark, small)
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    assert erosion.select("l_linenumber").distinct().count() == lines.select("l_linenumber").distinct().count() == 7
    assert abs(erosion.agg(F.sum("per_10k")).first()[0] - 10_000) < 0.01


def test_kmers_behind_base_500_vote(spark):
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(40))
    contigs = spark.createDataFrame([("i", "s", "u", "A" * 600 + ref)], "intBC string, sbc string, umi string, contig string")
    refs = spark.createDataFrame([("m1", ref), ("m2", "C" * 600 + ref[::-1])], "mod string, seq string")
    assert kmers.kmer_classify(contigs, refs).collect() == [("i", "m1", 1)]
    late = spark.createDataFrame([("i", "s", "u", ref[::-1])], "intBC string, sbc string, umi string, contig string")
    assert kmers.kmer_classify(late, refs).collect() == [("i", "m2", 1)]


def test_kmer_explode_goes_to_the_end(spark):
    df = spark.createDataFrame([("A" * 600,)], "v string")
    assert kmers.kmer_explode(df, "v", 15, only_unique=False).count() == 586
    assert kmers.kmer_explode(df, "v", 15, only_unique=False, max_str_len=500).count() == 500
