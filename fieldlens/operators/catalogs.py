"""Columns and statistics of a field catalog: entities, samples, templates, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import joins


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def business_entity(entities: dict[str, str] = fixed.ENTITIES) -> Column:
    """Entity by exact tag, else by the first key found in the path, else by pattern, else ''."""
    tag, path = F.col("tag"), F.col("path")
    pattern = F.lit("")
    for has, lacks, label in reversed(fixed.ENTITY_PATTERNS):
        cond = tag.contains(has) if lacks is None else tag.contains(has) & ~tag.contains(lacks)
        pattern = F.when(cond, label).otherwise(pattern)
    if not entities:
        return pattern
    in_path = F.try_element_at(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in entities.items()]),
                                        lambda e: path.contains(e["k"])), F.lit(1))["v"]
    return F.coalesce(_lookup(entities, tag), in_path, pattern)


def business_entity_by(catalog: DataFrame, entities: DataFrame) -> DataFrame:
    """Like ``business_entity`` for a user table (key, entity, ord).

    A key inside a path is found by joining the path's pieces of the keys' lengths, once per
    distinct path, so neither table is compared with all of the other.
    """
    sizes = entities.select(F.length("key").alias("size")).distinct().filter("size > 0")
    # as many rows as there are different key lengths
    lengths = [r.size for r in sizes.collect()]
    paths = catalog.select("path").distinct()
    sized = paths.withColumn("size", F.explode(F.array(*[F.lit(n) for n in lengths]))).filter(F.length("path") >= F.col("size"))
    pieces = sized.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("path") - F.col("size") + 1),
                                                        lambda i: F.substring(F.col("path"), i, F.col("size")))).alias("key")).distinct()
    inside = joins.dim_join(pieces, entities, ["key"], "inner").groupBy("path").agg(F.min_by("entity", "ord").alias("__inside"))
    exact = entities.groupBy(F.col("key").alias("tag")).agg(F.min_by("entity", "ord").alias("__exact"))
    known = joins.dim_join(joins.dim_join(catalog, exact, ["tag"]), inside, ["path"])
    return known.withColumn("entity", F.coalesce("__exact", "__inside", business_entity({}))).drop("__exact", "__inside")


def mapping_sample(base_type: str = "type") -> Column:
    """Sample value: by tag, else the first code, else by base type, else ``[tag]``."""
    low = F.lower(t.blank(base_type))
    has = low.contains
    by_type = (F.when(has("decimal"), "100.00").when(has("date") & has("time"), "2024-01-15T10:30:00").when(has("date"), "2024-01-15")
               .when(has("int"), "1").when(has("boolean"), "true"))
    first = F.when(F.size("enums") > 0, F.element_at("enums", 1))
    return F.coalesce(_lookup(fixed.MAPPING_SAMPLES, F.col("tag")), first, by_type, F.concat(F.lit("["), F.col("tag"), F.lit("]")))


def documented_sample(now: str, type_name: str = "type") -> Column:
    """Sample value of the documentation: pattern, first code, then type and name rules.

    ``now`` is an ISO timestamp; needs columns tag, type, pattern, enums, max_length, min_value.
    """
    tag, typ = F.col("tag"), t.blank(type_name)
    low, name = F.lower(typ), F.lower("tag")
    pattern = t.blank("pattern")
    digits = F.regexp_extract(pattern, r"\{(\d+)", 1).try_cast("int")
    by_pattern = (
        F.when(pattern == "[A-Z]{3,3}", "EUR").when(pattern == "[A-Z]{2}[0-9]{2}[A-Z0-9]+", "DE89370400440532013000")
        .when(pattern.contains("[A-Z]") & pattern.contains("{2}"), "DE")
        .when(pattern.startswith("[0-9]"), F.when(digits.isNotNull(), F.repeat(F.lit("1"), digits)).otherwise("123"))
        .otherwise(F.concat(F.lit("<matches: "), F.left(pattern, F.lit(30)), F.lit(">"))))
    limit = F.coalesce(F.col("max_length").try_cast("int"), F.lit(35))
    text = (F.when(tag.contains("Id") | name.contains("msgid"), F.concat(F.upper(tag), F.lit("001")))
            .when(tag.contains("Nm") | tag.contains("Name"), F.concat(F.lit("Sample "), tag))
            .when(tag.contains("Adr") | tag.contains("Address"), "123 Main Street").when(tag.contains("Ctry") | tag.contains("Country"), "DE")
            .when(tag.contains("Town"), "Frankfurt").otherwise(F.left(F.concat(F.lit("Sample"), tag), limit)))
    return (F.when(pattern != "", by_pattern).when(F.size("enums") > 0, F.element_at("enums", 1))
            .when(low.contains("iban") | tag.contains("IBAN"), "DE89370400440532013000").when(low.contains("bic") | tag.contains("BIC"), "DEUTDEFF")
            .when(low.contains("currency") | (tag == "Ccy"), "EUR").when(low.contains("datetime"), now + ".000Z")
            .when(low.contains("date") & ~low.contains("time"), now[:10]).when(low.contains("time") & ~low.contains("date"), "10:30:00")
            .when(low.contains("bool"), "true").when(low.contains("decimal") | tag.contains("Amount"), F.coalesce("min_value", F.lit("0.01")))
            .when(low.contains("int") | (tag == "NbOfTxs"), "1").when(low.contains("string") | typ.contains("Text"), text)
            .otherwise(F.concat(F.lit("<"), typ, F.lit(">"))))


def quick_reference(catalog: DataFrame, max_depth: int = 5) -> DataFrame:
    """Elements down to a depth, in sequence."""
    return catalog.filter((F.col("node_type") == "element") & (F.col("depth") <= max_depth)).orderBy("schema_id", "seq").select(
        "schema_id", "path", "tag", t.yes_no(F.col("min_occurs") != "0").alias("required"), "field_class")


def mapping_template(catalog: DataFrame, mandatory_only: bool = False) -> DataFrame:
    """Template rows with sample, pattern-or-codes text and blank work columns."""
    rows = catalog.filter(F.col("min_occurs") != "0") if mandatory_only else catalog
    enums = F.concat(F.array_join(F.slice("enums", 1, 5), ", "), F.when(F.size("enums") > 5, "...").otherwise(""))
    mark = lambda c: F.when(c, "✓").otherwise("")
    return rows.select(
        "schema_id", t.depth("path").alias("level"), "path", t.indent("tag", t.depth("path")).alias("element"), "type", "min_occurs", "max_occurs",
        mark(F.col("min_occurs") != "0").alias("mandatory"), F.when(F.size("enums") > 0, enums).otherwise(t.blank("pattern")).alias("pattern_or_codes"),
        mark(F.col("field_class") == "YELLOW").alias("yellow"), mark(F.col("field_class") == "WHITE").alias("white"), mapping_sample().alias("sample"),
        *[F.lit("").alias(c) for c in ("source_system", "source_field", "rule", "default_value", "notes", "status")])


def mapping_stats(catalog: DataFrame) -> DataFrame:
    required = F.col("min_occurs") != "0"
    return catalog.groupBy("schema_id").agg(
        F.count("*").alias("total"), F.count_if(required).alias("mandatory"), F.count_if(~required).alias("optional"),
        *[F.count_if(F.col("field_class") == c).alias(c.lower()) for c in ("YELLOW", "WHITE")])


def schema_stats(catalog: DataFrame) -> DataFrame:
    """Elements, attributes, required, optional, unbounded, depth and types per schema, with percents."""
    one = catalog.groupBy("schema_id").agg(
        F.count_if(F.col("node_type") == "element").alias("elements"), F.count_if(F.col("node_type") == "attribute").alias("attributes"),
        F.count_if(~F.col("min_occurs").isin("0", "")).alias("required"), F.count_if(F.col("min_occurs") == "0").alias("optional"),
        F.count_if(F.col("max_occurs") == "unbounded").alias("unbounded"), F.max(t.depth("path")).alias("max_depth"), F.count_distinct("type").alias("types"))
    share = lambda c: F.floor(F.try_divide(F.col(c) * 100.0, F.col("elements")) + 0.5).cast("bigint").alias(f"{c}_pct")
    return one.select("*", share("required"), share("optional"), share("unbounded"))


def type_usage(catalog: DataFrame, k: int = 20) -> DataFrame:
    """Most used types; ties by name."""
    return catalog.filter(t.blank("type") != "").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(k)
