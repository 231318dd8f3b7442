"""One query for each operator, over its whole table, as digests of the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import (
    binary_packing,
    decontamination,
    extraction,
    language,
    merkle,
    near_dedup,
    nn_descent,
    packing,
    quality,
    secret_scan,
    sharding,
    spelling,
    token_counts,
)
from salesloom.llm.sql import DECONTAMINATION, MANIFEST, SECRETS, SPELLING
from salesloom.workspace import delete_path, new_path, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of the session and the folder of tables."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts read from flat files of all documents; the files go afterwards."""
    folder = new_path(spark, "tokens")
    found = stage(token_counts.counted(table(spark, sf_dir, "documents"), folder), "counts")
    delete_path(spark, folder)
    return found


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_decontamination", DECONTAMINATION)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), bare=True
    )
    return found.select(
        "doc_id",
        "item_id",
        F.round("question_overlap", 6).alias("question_overlap"),
        F.round("answer_overlap", 6).alias("answer_overlap"),
    )


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out("doc_id")
    model = language.train(docs.where(~held))
    found = language.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op6_extraction")
def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def _is(wanted: str) -> Callable[[Column], Column]:
    return lambda value: value == wanted


@query("op9_secrets", SECRETS)
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, _is(kind))).cast("long").alias(f"n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


@query("op10_binary_packing")
def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed files of all documents; the files stay in the shared folder."""
    return binary_packing.pack(table(spark, sf_dir, "documents"), new_path(spark, "packed"))


QUERY_EVERY = 20


@query("op11_nn_descent")
def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id ``QUERY_EVERY`` divides, against all others."""
    rows = table(spark, sf_dir, "embeddings")
    index = nn_descent.build(rows, "vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % QUERY_EVERY == 0)
    found = nn_descent.search(index, asked, "vec_id", "embedding")
    return found.withColumnRenamed("id", "vec_id")


@query("op12_spelling", SPELLING)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_manifest", MANIFEST)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))
