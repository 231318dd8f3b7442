"""Stages that turn the documents table into a clean, packed training corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesloom.llm import decontamination, language, near_dedup, packing, secret_scan
from salesloom.workspace import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Similarity of five-word sets from which two documents are near copies, in percent, and
# the hash bands for it: a pair at the threshold shares none with a chance of 3e-6. The
# query of near-dedup alone has the 85 of its own contract.
NEAR_PERCENT, NEAR_BANDS = 80, 24


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit no language model of the corpus go; the models count all documents."""
    model = language.train(docs)
    return language.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 percent and more) stays."""
    return near_dedup.one_of_each(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, whatever signs stick to its words."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), bare=True, in_order=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secret_scan.redacted(docs, length="n_chars")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_test_items),
    ("secrets", mask_secrets),
    ("packing", pack_documents),
]

# Language models, hash bands and packing have no SQL form; tests hold the stages
# against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
