"""Registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, merkle_manifest, mixing, pii, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash_dedup, spelling_variants, substring_dedup, token_counts, toxicity
from ._common import documents, materialize


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), path)
    back = F.col("decoded") == F.coalesce(F.translate("text", sentencepiece_codec.MARK, " "), F.lit(""))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), back.alias("round_trip"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(mixing.measure(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text"), "op6-sizes")
    return mixing.mix_documents(sized).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot", "pieces")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    measured = materialize(quality_rules.with_measures(docs).drop("text"), "op9-measures")
    return quality_rules.judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(materialize(sharding.describe(documents(spark, sf_dir)), "op10-rows"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(documents(spark, sf_dir).select("doc_id", "text"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir).select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_pii": op2_pii,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_token_counts": op4_token_counts,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_quality_rules": op9_quality_rules,
        "op10_sharding": op10_sharding,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
        "op9_quality_rules": quality_rules.ORACLE_SQL,
        "op11_spelling_variants": spelling_variants.ORACLE_SQL,
        "op12_substring_dedup": substring_dedup.ORACLE_SQL,
        "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
    }
