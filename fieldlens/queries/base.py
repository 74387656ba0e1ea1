"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlens import fixtures
from fieldlens.functions import lists


def catalog(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.frame(spark, sf_dir, name).withColumn("enums", lists.from_text("enums"))


def count_stars(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
