"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

language -> near_duplicates -> decontamination -> secrets -> mixing. The first three drop rows, the fourth masks secrets
in the text, the last places every remaining document in a stream mixed to target weights. Tables with other columns
keep them up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlens.llm import decontam, jaccard, language, mixing, secret_scan
from fieldlens.llm.base import table
from fieldlens.session import scratch_folder

LEAST_SCORE = 0.05  # a text that resembles no language at all


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; texts without a letter and texts like none of them go."""
    names = docs.columns
    prototypes = language.train(docs, "text", "lang")
    judged = language.predict(docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"}), prototypes, "text")
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"}).select(*[F.col(f"`{n}`") for n in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest id."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked and n_chars counted anew where they were."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the place of every document in the stream mixed to target weights."""
    return mixing.mix_exact(docs, mixing.balanced(docs))


STAGES = [("language", identify), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixed)]

ORACLE_SQL = None  # language identification and secret lexing are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
