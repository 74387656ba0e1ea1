"""Schema, guide, JSON, YAML and file sources."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import files
from fieldlens.sources.messages import whole_files

GUIDE_SCHEMA = ("message string, idx string, mult string, xpath string, element_name string, tag string, type string, length string, usage_rule string, "
                "rulebook string, format_rule string, code_restrictions string, iso_definition string, row_color string, pos bigint")


def read_schema_docs(spark: SparkSession, path: str | Sequence[str], glob: str = "*.xsd", key: str | None = None) -> DataFrame:
    """(schema_id, text) of schema documents; the id is the file name without its suffix, or with ``key`` as in ``whole_files``."""
    rows = whole_files(spark, path, glob, key)
    return rows.select((F.col("name") if key else F.regexp_replace("name", r"\.[^.]*$", "")).alias("schema_id"), F.col("value").alias("text"))


def read_guide(spark: SparkSession, path: str, scheme: str, fmt: str = "parquet") -> DataFrame:
    """Guide table of extracted sheets with an explicit schema; rows without xpath and the summary are left out.

    In CSV the sheet comes from a ``message`` column as well; repeated xpaths are kept, see ``keep_last``.
    """
    reader = spark.read.schema(GUIDE_SCHEMA)
    rows = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return rows.filter((F.trim(t.blank("xpath")) != "") & (F.col("message") != "Summary")).withColumn("scheme", F.lit(scheme))


def read_json_docs(spark: SparkSession, path: str | Sequence[str], glob: str = "*.json", key: str | None = None) -> DataFrame:
    """(doc_id, json, doc): JSON text and its VARIANT (null when unreadable)."""
    return whole_files(spark, path, glob, key).toDF("doc_id", "json").withColumn("doc", F.try_parse_json("json"))


def read_yaml_docs(spark: SparkSession, path: str | Sequence[str], glob: str = "*.y*ml", key: str | None = None) -> DataFrame:
    """(doc_id, json, doc): YAML normalised to JSON text (null when unreadable) and its VARIANT."""
    def to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def one(text):
            try:
                return json.dumps(yaml.safe_load(text), default=str, ensure_ascii=False)
            except yaml.YAMLError:
                return None

        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "json": batch["value"].map(one)})

    rows = whole_files(spark, path, glob, key).withColumnRenamed("name", "doc_id")
    return rows.mapInPandas(to_json, "doc_id string, json string").withColumn("doc", F.try_parse_json("json"))


def file_inventory(spark: SparkSession, path: str, allowed: Sequence[str] = fixed.UPLOAD_EXTENSIONS) -> DataFrame:
    """Name, folder, extension, size in KB and modified time of the files below a folder; contents are not read."""
    root = path.rstrip("/")
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    inside = F.substr(F.col("path"), F.instr("path", root) + F.lit(len(root) + 1))
    folder = F.when(inside.contains("/"), F.regexp_replace(inside, "/[^/]*$", "")).otherwise("")
    rows = meta.select(t.last_segment("path").alias("file"), folder.alias("folder"), F.col("length").alias("size"),
                       F.col("modificationTime").alias("modified"))
    return files.inventory(rows, allowed)
