"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import contaminated, find_contamination
from .html import extract_main_text
from .language import fit_languages, identify_languages
from .lm import score_stupid_backoff
from .media import wav_media
from .ngram_join import jaccard_join
from .oracles import OP2, OP4, OP5, OP7, OP12
from .packing import pack
from .quality import fit_quality, score_quality
from .secrets import scan_secrets
from .sharding import balanced_shards
from .spelling import group_spellings
from .token_alignment import align_tokenizers
from .token_store import read_token_store, write_token_store


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wav_media(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("fingerprint_sha256", "feature")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contaminated(hits).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = fit_languages(docs.where(~fold))
    return identify_languages(docs, model).withColumn("held_out", F.coalesce(fold, F.lit(False)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_stupid_backoff(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.round("lm_log10", 3).alias("lm_log10"), F.round("lm_mean", 6).alias("lm_mean"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs)).withColumn("quality", F.round("quality", 6))


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_store(spark, write_token_store(docs, tokenizer_path("byte_bpe_50k.json")), docs)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_decontamination": op2_decontamination,
    "op3_language": op3_language,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_sharding": op5_sharding,
    "op6_html": op6_html,
    "op7_lm": op7_lm,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_token_store": op11_token_store,
    "op12_spelling": op12_spelling,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2, "op4_jaccard_join": OP4, "op5_sharding": OP5, "op7_lm": OP7, "op12_spelling": OP12}
