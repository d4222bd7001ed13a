"""A training corpus from ``documents``: rules, near duplicates, personal data, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage
reads it from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm import mixing, pii, quality_rules, sentencepiece_codec, simhash_dedup
from tickspark.llm._common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash_dedup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that give it away; ``n_chars`` follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.repeat_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text that they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode_and_decode(docs, path)
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), F.length("decoded").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixture),
    ("SentencePiece", pieces),
]

#: SimHash components and pieces are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
