"""Rows that are mostly copies of few texts hide neither a language nor a class."""

import shutil

import pytest
from pyspark.sql import functions as F

from molspark.llm import language, quality

JUNK = "$$$ ### BUY !!! BUY !!! $$$ ### CLICK >>> HERE <<< $$$ !!! WIN WIN WIN $$$ ### " * 4
FRENCH = ["le chat noir dort sur la table de la grande maison et il ne veut pas partir avec les autres",
          "nous avons mangé des pommes rouges dans le jardin pendant que les enfants jouaient au ballon",
          "la rivière coule lentement entre les collines vertes où paissent les moutons du village",
          "elle a écrit une longue lettre à son frère pour lui raconter toutes les nouvelles de la ville",
          "les étoiles brillent dans le ciel sombre pendant que le vent souffle sur la mer agitée"]


def english(i):
    words = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do".split()
    return " ".join(words[(i * 7 + k * (i % 5 + 3)) % len(words)] for k in range(60)) + f". And so it was number {i}."


def sentences(spark, n):
    return spark.createDataFrame([(i, english(i) + " The people of the town came to see what was there, and they said that it was good.") for i in range(n)], "doc_id long, text string")


def test_language_of_copies(spark):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, FRENCH)), (F.col("id") % 5 + 1).cast("int")).alias("text"), F.lit("fr").alias("lang"))
    both = rows.unionByName(sentences(spark, 300).withColumn("lang", F.lit("en"))).repartition(8)
    model = language.fit_languages(both)
    assert set(model.dictionaries) == {"en", "fr"}
    got = {r.lang_pred for r in language.identify_languages(rows.limit(50), model).collect()}
    assert got == {"fr"}


@pytest.fixture(scope="module")
def junk(spark):
    return spark.range(1_000_000, 1_060_000).select(F.col("id").alias("doc_id"), F.lit(JUNK).alias("text"))


def test_quality_of_copies(spark, junk):
    docs = sentences(spark, 400).unionByName(junk).repartition(8)
    got = quality.score_quality(docs, quality.fit_quality(docs)).groupBy(F.col("doc_id") >= 1_000_000, "keep").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(False, True): 400, (True, False): 60_000}


def test_pipeline_drops_copied_junk(spark, junk, tmp_path):
    import corpus_pipeline

    docs = sentences(spark, 400).unionByName(junk).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", tmp_path / "benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert kept and max(kept) < 1_000_000


def test_columns_that_clash(spark):
    """A table may hold the names that the pipeline's stages give their own columns; it comes out with all its columns."""
    from molspark.llm.decontamination import drop_contaminated
    from molspark.llm.ngram_join import keep_one_of_each_class

    clash = ["__th", "__pk", "__KEPT", "__m", "__bad", "__bit", "__no", "__at", "__map", "__map_no", "th", "n", "rows"]
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:59], "other"]), "a clean text of few words", None, ""]
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in clash]) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash))
    bench = spark.createDataFrame([("b", " ".join(words[20:40]))], "item_id string, text string")
    kept = keep_one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [tuple(r) for r in docs.orderBy("doc_id").collect() if r.doc_id in (0, 3, 4, 5)]
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect())) == [tuple(r) for r in docs.orderBy("doc_id").collect() if r.doc_id >= 3]
