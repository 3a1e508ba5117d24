"""The training-data pipeline over ``documents``: each stage reads what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which ``run`` writes as Parquet and reads again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracefold.llm import common, exact_dedup, langid, ngram_join, packing


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know."""
    return langid.keep_identified(docs)


def keep_exact_owners(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space, the row with most code points, then the smallest id."""
    return exact_dedup.kept_documents(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest id; documents without words are no one's copy."""
    return ngram_join.kept_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", keep_exact_owners),
    ("ngram_join", keep_one_of_similar),
    ("packing", pack_tokens),
]

#: SQL has no language profiles and no tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
