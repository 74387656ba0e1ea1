"""Registered queries of this folder, with oracle SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlens.llm import alignment, centroids, chat, decontam, jaccard, kneser_ney, language, mixing, quality_rules, secret_scan, suffixes, toxicity, wrappers
from fieldlens.llm.base import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, ~language.held_out())
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "exact")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.balanced(docs))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), kneser_ney.trusted(table(spark, sf_dir, "labels")))


def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.finished(chat.with_probe(table(spark, sf_dir, "conversations")))
    return chat.digests(chat.render(chat.fold(log)))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES = {f.__name__: f for f in (
    op1_language, op2_quality_rules, op3_decontamination, op4_jaccard, op5_suffix_dedup, op6_toxicity, op7_secrets, op8_mixing, op9_kneser_ney, op10_wrappers,
    op11_chat, op12_alignment, op13_centroids)}
ORACLES = {"op8_mixing": mixing.oracle(), "op11_chat": chat.oracle(), "op13_centroids": centroids.oracle()}
