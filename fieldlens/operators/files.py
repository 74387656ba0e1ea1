"""File inventories: admission, retention, folder counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldlens import fixed
from fieldlens.operators import joins


def extension(file: str = "file") -> Column:
    return F.lower(F.regexp_extract(F.col(file), r"\.([^.]+)$", 1))


def inventory(files: DataFrame, allowed: Sequence[str] = fixed.UPLOAD_EXTENSIONS) -> DataFrame:
    """Name, extension and size in KB of the files worth listing; hidden files and README.md are not."""
    name = F.col("file")
    return files.filter(~name.startswith(".") & (name != "README.md") & extension().isin(*allowed)).withColumn(
        "ext", F.concat(F.lit("."), extension())).withColumn("size_kb", F.floor(F.col("size") / 1024.0 * 10 + 0.5) / 10)


def admit(files: DataFrame, allowed: Sequence[str] = fixed.UPLOAD_EXTENSIONS, max_bytes: int = fixed.MAX_FILE_BYTES,
          max_files: int | None = fixed.MAX_FILES, batch: str = "batch") -> DataFrame:
    """Reason per file: bad extension, too large, empty, over the batch limit, or ok."""
    reason = (F.when(~extension().isin(*allowed), "invalid type").when(F.col("size") > max_bytes, "too large")
              .when(F.col("size") == 0, "empty").otherwise("ok"))
    rows = files.withColumn("reason", reason)
    if max_files is None:
        return rows
    counts = files.groupBy(batch).agg(F.count("*").alias("__n"))
    return joins.dim_join(rows, counts, [batch], "inner").withColumn("reason", F.when(F.col("__n") > max_files, "too many files").otherwise(F.col("reason"))).drop("__n")


def expired(files: DataFrame, hours: int, age: str = "age_hours") -> DataFrame:
    return files.filter(F.col(age) > hours)


def older_than(ts: str, hours: int, now: Column) -> Column:
    return F.col(ts) < now - F.expr(f"interval {int(hours)} hours")


def folder_counts(files: DataFrame) -> DataFrame:
    """Files per folder with all descendants counted."""
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # files are counted per folder first, so only folder totals are multiplied by their depth
    per = files.groupBy("folder").agg(F.count("*").alias("n"))
    return per.select(F.explode(up).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("n_files"))


def folder_totals(files: DataFrame, area: str = "folder") -> DataFrame:
    return files.groupBy(area).agg(F.count("*").alias("n_files"), (F.floor(F.sum("size") / 1048576.0 * 100 + 0.5) / 100).alias("size_mb"))


def tree(files: DataFrame) -> DataFrame:
    """Folders before files, each by case-insensitive name."""
    folders = files.select(F.lit(False).alias("is_file"), F.col("folder").alias("name")).distinct()
    entries = files.select(F.lit(True).alias("is_file"), F.concat("folder", F.lit("/"), "file").alias("name"))
    return folders.unionByName(entries).orderBy("is_file", F.lower("name"), "name")
