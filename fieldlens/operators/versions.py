"""Many versions of a catalog: consecutive diffs, presence matrix, class evolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import joins
from fieldlens.operators.schema_diff import pair_by_path, schema_diff, severity_rank  # noqa: F401


def schema_list(catalog: DataFrame) -> DataFrame:
    """The distinct schemas with their position (order of their id)."""
    ids = catalog.select("schema_id").distinct()
    return ids.withColumn("pos", F.row_number().over(W.orderBy("schema_id")))


def pair_consecutive(schemas: DataFrame) -> DataFrame:
    """Each version with the next one: (pair, left_id, right_id, pos). One row per version."""
    nxt = F.lead("schema_id").over(W.orderBy("pos"))
    return (schemas.select(F.col("schema_id").alias("left_id"), nxt.alias("right_id"), "pos")
            .filter(F.col("right_id").isNotNull())
            .withColumn("pair", F.concat("left_id", F.lit(" -> "), "right_id")))


def consecutive_diffs(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes of every pair of versions in one join keyed by (pair, path)."""
    left = joins.dim_join(catalog, pairs.select(F.col("left_id").alias("schema_id"), "pair"), ["schema_id"], "inner")
    right = joins.dim_join(catalog, pairs.select(F.col("right_id").alias("schema_id"), "pair"), ["schema_id"], "inner")
    return schema_diff(left, right, by=("pair",))


def matrix(catalog: DataFrame, schema_ids: Sequence[str], fields: Sequence[str] = ("type", "min_occurs", "max_occurs", "field_class")) -> DataFrame:
    """One row per path, and per schema a presence flag and its attributes."""
    aggs = []
    for s in schema_ids:
        here = F.col("schema_id") == s
        aggs.append(F.max(here).alias(f"{s}_present"))
        aggs += [F.max(F.when(here, F.col(f))).alias(f"{s}_{f}") for f in fields]
    return catalog.filter(F.col("schema_id").isin(*schema_ids)).groupBy("path").agg(*aggs)


def evolution(catalog: DataFrame, schema_ids: Sequence[str]) -> DataFrame:
    """Classes of each path over the versions: text, changed flag, arrows or Stable."""
    aggs = [F.max(F.when(F.col("schema_id") == s, F.coalesce("field_class", F.lit("NA")))).alias(f"c{i}")
            for i, s in enumerate(schema_ids)]
    wide = catalog.filter(F.col("schema_id").isin(*schema_ids)).groupBy("path").agg(*aggs)
    classes = F.array(*[F.col(f"c{i}") for i in range(len(schema_ids))])
    shown = F.transform(classes, lambda c: F.coalesce(c, F.lit("N/A")))
    known = F.array_compact(F.array_distinct(classes))
    changed = F.size(known) > 1
    arrows = F.array_join(F.transform(classes, lambda c: F.coalesce(c, F.lit("?"))), " → ")
    return wide.filter(F.arrays_overlap(known, F.array(F.lit("YELLOW"), F.lit("WHITE")))).select(
        "path", t.last_segment("path").alias("element"), F.array_join(shown, ", ").alias("classes"),
        t.yes_no(changed).alias("changed"), F.when(changed, arrows).otherwise("Stable").alias("evolution"))


def class_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("schema_id").agg(
        *[F.count_if(F.coalesce("field_class", F.lit("NA")) == c).alias(c.lower()) for c in ("YELLOW", "WHITE", "NA")])


def class_change_count(catalog: DataFrame) -> DataFrame:
    """How many paths carry more than one class over the versions, NA ignored."""
    per_path = (catalog.filter(F.col("field_class").isin("YELLOW", "WHITE")).groupBy("path")
                .agg(F.min("field_class").alias("lo"), F.max("field_class").alias("hi")))
    return per_path.agg(F.count_if(F.col("lo") != F.col("hi")).alias("n"))


def change_summary(catalog: DataFrame, diffs: DataFrame, n: int = 3) -> DataFrame:
    """Per path: change types, highest severity and the first changes; or No Change.

    A path has at most a dozen changes per pair of versions, so its list is bounded.
    """
    shown = lambda c: F.when(t.blank(c) == "", "N/A").otherwise(F.left(c, F.lit(20)))
    order = F.array_position(F.array(*[F.lit(x) for x in fixed.CHANGE_TYPES]), F.col("change_type"))
    one = F.concat("change_type", F.lit(": "), shown("old_value"), F.lit(" → "), shown("new_value"))
    per_path = diffs.groupBy("path").agg(
        F.array_sort(F.collect_set("change_type")).alias("types"), F.min(severity_rank()).alias("rank"),
        F.array_sort(F.collect_list(F.struct("pair", order.alias("o"), one.alias("text")))).alias("rows"))
    text = F.transform("rows", lambda r: r["text"])
    more = F.when(F.size("rows") > n, F.concat(F.lit(" | ...+"), (F.size("rows") - n).cast("string"), F.lit(" more"))).otherwise("")
    summed = per_path.select(
        "path", F.array_join("types", ", ").alias("change_types"),
        F.element_at(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), F.col("rank") + 1).alias("max_severity"),
        F.concat(F.array_join(F.slice(text, 1, n), " | "), more).alias("summary"))
    paths = catalog.groupBy("path").agg(F.lit(1).alias("one")).drop("one")
    return paths.join(summed, "path", "left").select(
        "path", F.coalesce("change_types", F.lit("No Change")).alias("change_types"),
        F.coalesce("max_severity", F.lit("")).alias("max_severity"), F.coalesce("summary", F.lit("")).alias("summary"))


# ---- sets of paths -----------------------------------------------------------------

def all_paths(catalog: DataFrame) -> DataFrame:
    """Union of all paths with the first position at which each was seen."""
    return catalog.groupBy("path").agg(F.min(F.struct("schema_id", "seq")).alias("first")).select(
        "path", F.col("first.schema_id").alias("first_schema"), F.col("first.seq").alias("first_seq"))


def common_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").intersect(b.select("path"))


def only_left(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").subtract(b.select("path"))
