"""Queries whose time must grow no faster than their tables: what their plans hold, and results against a plain way."""

import random

import pytest
from pyspark.sql import functions as F

from molspark.functions import sql
from molspark.functions.sequence import fuzzy_pattern
from molspark.operators import align, cassette, ibars, kmers, reads
from molspark.plans.constants import END, METAS, START


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def damaged(rng, text):
    """``text``, or with a letter lost, replaced or put in."""
    i = rng.randrange(len(text))
    return rng.choice((text, text, text[:i] + text[i + 1 :], text[:i] + rng.choice("ACGTN") + text[i + 1 :], text[:i] + "A" + text[i:]))


FEATURES = (ibars.TSO, ibars.U6, ibars.BROKEN_U6, ibars.DOWNSTREAM, ibars.CANONICAL, ibars.PRIMER, ibars.SCAFFOLD2, ibars.STAMMER, "CTAGA", "CTAGAACGTAC" + ibars.DOWNSTREAM)


@pytest.mark.parametrize("zombie", [False, True])
def test_encoding_is_that_of_the_flat_rules(spark, zombie):
    """Against the rules as Spark's patterns, one after another; some texts have several lines or letters outside ASCII."""
    rng = random.Random(9)
    seqs = ["".join(rng.choice((damaged(rng, rng.choice(FEATURES)), "".join(rng.choices("ACGT", k=rng.randrange(5))), rng.choice(("", "", "", "\n", "\r\n", " ", "é", "𝔊")))) for _ in range(rng.randrange(14))) for _ in range(1500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, "", None])], "id int, seq string")
    flat = df.withColumn("oseq", F.col("seq"))
    for k, (pattern, token, _) in enumerate(ibars.encode_rules(zombie)):
        if k == 3:
            raw = f"CTAGA(.{{6}})({fuzzy_pattern(ibars.DOWNSTREAM)})"
            flat = flat.withColumn("raw_ibar", F.nullif(F.regexp_extract("seq", raw, 1), F.lit("")))
        flat = flat.withColumn("seq", F.regexp_replace("seq", pattern, token)).cache()
    got = {r.id: r for r in ibars.encode_reads(df, zombie).collect()}
    for r in flat.collect():
        assert (got[r.id].seq, got[r.id].oseq, got[r.id].raw_ibar) == (r.seq, r.oseq, r.raw_ibar), r.oseq


@pytest.mark.parametrize("map_bytes", [0, None])
def test_spacers_by_lookup_and_by_join(spark, map_bytes):
    """Same results; a whitelist that a task can hold needs no shuffle of the rows."""
    rng = random.Random(4)
    white = spark.createDataFrame([(x,) for x in ("ACG", "ACGT", "CGTA", "TTT", "")], "spacer string")
    seqs = ["".join(rng.choices("ACGT", k=25)) for _ in range(60)] + ["", "GGACGTATTTT", "CTAGA", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string").coalesce(1)
    want = {len(seqs) - 3: ("ACG", "GG[···WT···]TA[···WT···]T"), len(seqs) - 4: ("", ""), len(seqs) - 1: (None, None)}
    first, coded = ibars.extract_spacer(df, white, map_bytes), ibars.encode_wt(df, white, map_bytes)
    got = {r.id: r.spacer for r in first.collect()}, {r.id: r.seq for r in coded.collect()}
    assert {i: (got[0][i], got[1][i]) for i in want} == want and len(got[0]) == len(got[1]) == len(seqs)
    if map_bytes is None:
        assert "Exchange" not in plan_of(first) and "Exchange" not in plan_of(coded)


def test_molecules_shuffle_reads_once(spark):
    rows = [("c", "u1", "b", "A", "x"), ("c", "u1", "b", "A", "w"), ("c", "u1", "b", "B", "y"), ("c", "u2", "b", "A", "x"), ("c", "u2", "b", "B", "y"), ("c", "u3", None, "A", "x"), (None, "u4", "b", "C", "z")]
    m = ibars.ibar_molecules(spark.createDataFrame(rows, "cbc string, umi string, raw_ibar string, seq string, oseq string"))
    assert sorted(map(tuple, m.collect()), key=str) == sorted([("c", "u1", "b", 3, 2, "A", "w"), (None, "u4", "b", 1, 1, "C", "z")], key=str)
    assert plan_of(m).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_molecules_are_made_once(spark):
    """Counts come from the stored molecules: the reads are encoded once, not once for each count."""
    seq = "ACTG" + ibars.TSO + "ACGTACGTACGTACGTACGT" + "GGGTTAGAGCTAGA{}" + ibars.DOWNSTREAM + "GTTAACC"
    rows = [("c1", f"u{k}", seq.format("ACGTAC")) for k in range(3)] + [("c1", "u9", seq.format("ACGTAC").replace("ACGTACGTACGT", "TTTTACGTACGT")), ("c2", "u1", seq.format("CCCCCC"))]
    out = ibars.reads_to_molecules(spark.createDataFrame(rows, "cbc string, umi string, seq string"), spark.createDataFrame([("ACGTACGTACGTACGTACGT",)], "spacer string"))
    assert sorted((r.cbc, r.umi, r.umis_allele, r.n_sib) for r in out.collect()) == [("c1", "u0", 3, 2), ("c1", "u1", 3, 2), ("c1", "u2", 3, 2), ("c1", "u9", 1, 2), ("c2", "u1", 1, 1)]
    assert "ArrowEvalPython" not in plan_of(out)


@pytest.mark.parametrize("k", [1, 5, 12, 13])
def test_kmers_of_references_are_found_in_the_task(spark, k):
    """As by the join of all k-mers, but contigs are not exploded; some letters are outside ASCII, some contigs null or shorter than k."""
    rng = random.Random(k)
    refs = [(rng.choice(("m1", "m2", "m3")), "".join(rng.choices("ACGT", k=30)) + rng.choice(("", "é𝔊AC"))) for _ in range(6)] if k > 1 else [("m1", "A"), ("m2", "C𝔊")]
    contigs = [(f"i{rng.randrange(4)}", rng.choice("st"), f"u{rng.randrange(30)}", rng.choice(("", "G𝔊", "é")) + rng.choice(refs)[1][rng.randrange(20) :] + rng.choice(refs)[1][: rng.randrange(30)]) for _ in range(300)]
    df = spark.createDataFrame([*contigs, ("i1", "s", "u1", None), ("i1", "s", "u1", ""), (None, "s", "u1", refs[0][1])], "intBC string, sbc string, umi string, contig string")
    refs = spark.createDataFrame(refs, "mod string, seq string")
    here, joined = kmers.kmer_classify(df, refs, k), kmers.kmer_classify(df, refs, k, known_kmers=0)
    rows = sorted(map(tuple, here.collect()), key=str)
    assert rows and rows == sorted(map(tuple, joined.collect()), key=str)
    assert "substring" not in plan_of(here) and "substring" in plan_of(joined)
    assert kmers.kmer_classify(df, refs.limit(0), k).count() == 0


def test_cleaning_and_segments_of_damaged_cassettes(spark):
    """Cleaned as by the flat patterns; segments in one pass of Arrow batches, with no pattern or list function left in the plan."""
    rng = random.Random(12)
    parts = [*METAS.values(), START, END]
    seqs = ["".join(damaged(rng, rng.choice(parts)) + rng.choice(("", "AC", "\n", "é")) for _ in range(rng.randrange(9))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, START + METAS["META02"] + "GG" + METAS["META01"] + "T" + END, None])], "id int, seq string")
    flat = df
    for text in parts:
        flat = flat.withColumn("seq", F.regexp_replace("seq", fuzzy_pattern(text), text))
    clean = reads.fuzzy_sanitize(df, list(METAS.values()), [START, END])
    assert sorted(map(tuple, clean.collect())) == sorted(map(tuple, flat.collect()))
    got = cassette.segment_by_metas(df, METAS, START, END, "seq", ["id"])
    assert [tuple(r)[1:] for r in got.where(f"id = {len(seqs)}").collect()] == [
        ("META02", "META01", METAS["META02"] + "GG" + METAS["META01"]), ("_CASSETTE_START_", "META02", START + METAS["META02"]), ("META01", "_CASSETTE_END_", METAS["META01"] + "T" + END)]
    assert "regexp" not in plan_of(got) and "transform(" not in plan_of(got)


def test_sql_kmers_in_linear_time(spark):
    """A text of 200,000 letters, in ASCII or not, and letters beyond the first plane."""
    sql.register(spark)
    texts = ["ACGT" * 50_000, "AC𝔊\nT" * 40_000, "𝔊é", "A"]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("texts")
    got = {r.t: (r.n, r.some) for r in spark.sql("SELECT t, size(kmers(t, 5)) AS n, array_sort(array_distinct(kmers(t, 5))) AS some FROM texts").collect()}
    for t in texts:
        want = [t[i : i + 5] for i in range(len(t) - 4)]
        assert got[t] == (len(want), sorted(set(want)))


def test_alignments_are_made_once(spark):
    """Reads meet stored alignments in one join; sizes and references are those of all reads, copies included."""
    rows = [("g", "u1", "AACCGGTTA", True), ("g", "u2", "AACCGGTTA", True), ("g", "u3", "AACGGTTA", False), ("h", "u4", "AACCTTA", True), (None, "u5", "AACCTTA", True), ("k", "u6", "AACTTA", False), ("k", "u7", "AACTTA", None)]
    df = spark.createDataFrame(rows, "grp string, umi string, seq string, wt boolean")
    out = align.align_alleles(df, ["grp"], "AAC", "TTA", min_group_size=2, fuzzy=False)
    assert out.columns == ["seq", "ref", "grp", "umi", "wt", "cigar_str", "aligned_ref", "aligned_seq", "alignment_score"]
    assert sorted((r.umi, r.ref, r.seq) for r in out.collect()) == [("u1", "AACCGGTTA", "AACCGGTTA"), ("u2", "AACCGGTTA", "AACCGGTTA"), ("u3", "AACCGGTTA", "AACGGTTA")]
    given = align.align_alleles(df.drop("wt"), ["grp"], "AAC", "TTA", refs=spark.createDataFrame([("k", "AACCTTA", 1), ("k", "AACTTA", 2)], "grp string, ref string, no int"), fuzzy=False)
    assert sorted((r.umi, r.no, r.ref) for r in given.collect()) == [("u6", 1, "AACCTTA"), ("u6", 2, "AACTTA"), ("u7", 1, "AACCTTA"), ("u7", 2, "AACTTA")]
    assert "MapInArrow" not in plan_of(out)


def test_molecules_of_a_sample_are_not_shuffled_to_one_task(spark):
    mols = spark.range(4000).selectExpr("'S1' AS sample_id", "concat('c', id % 3) AS cbc", "cast(id AS string) AS umi", "concat('b', id % 2) AS raw_ibar")
    out = reads.ingest_experiments([mols], spark.createDataFrame([("S1", "1")], "sample_id string, batch string"), spark.createDataFrame([("c0-1",), ("c0-1",)], "cbc string"), 3)
    assert "Exchange hashpartitioning" not in plan_of(out) and out.count() == 1334
