"""From raw documents to packed training sequences: STAGES in order, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm import exact_dedup, langid, packing, quality, simhash
from ticketlake.llm.common import fold, fresh_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter, or torn between languages, go.

    The languages are learned from the documents whose fold of three is not 1.
    """
    model = langid.fit(docs, fold(3) != 1, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return langid.identified(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and no rule rejects; the rules are learned from ``labels``."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, one stays."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints hang together within two bits, one stays."""
    return simhash.keep_one(docs, words=3, max_bits=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.pieces(docs, path, public_tokenizers.PATTERN, 2048), 2048)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("packing", packed),
]

ORACLE_SQL = None  # trained models and packing are beyond SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
