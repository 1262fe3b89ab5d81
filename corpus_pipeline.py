"""A training-corpus pipeline out of five operators: quality, near duplicates, secrets, mixture, tokens.

Every function takes (spark, docs, sf_dir) and returns a table; each works on all that the one before kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import bpe, jaccard, mil, mixing, secrets
from rangeloom.llm.common import drop, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return mil.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: its least doc_id."""
    return jaccard.one_of_each(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; n_chars follows the text."""
    return secrets.mask_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_masking", secret_masking), ("mixture", mixture), ("tokens", tokens)]

#: Learned, similarity-joined, rounded at random by hashes and tokenized: not SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's table goes as soon as the next one stands; the last stage's input stays while its result can be read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, at = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(spark, *before)
        before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
