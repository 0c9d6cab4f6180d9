"""A training corpus from `documents`: quality, exact and near copies, secrets, packing.

Each stage reads what the one before it wrote. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hardwood.llm import exact, importance, oddsketch, packing, secrets
from hardwood.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what importance resampling rejects."""
    return importance.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts that are equal but for white space."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that links of a similarity of 0.8 or more connect."""
    return oddsketch.drop_near_copies(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    # the workers have served the other stages too: they remember fewer pieces than in a query of its own
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), pieces=60_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mask_secrets", mask_secrets), ("pack", pack),
]

#: The classifier's hashed model, the MinHash components and the tokenizer aren't SQL; tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
