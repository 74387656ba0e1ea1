"""Differences between two versions of a field catalog.

Both sides meet once on (keys, path); every change of a field is then a struct in an
array that is filtered and exploded, so all rules share a single join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import joins

FIELDS = ("seq", "tag", "type", "min_occurs", "max_occurs", "restrictions", "field_class",
          "fixed", "dflt", "rulebook", "usage_rules", "enums")
LAST = 999_999_999


def pair_by_path(a: DataFrame, b: DataFrame, by: Sequence[str] = (), fields: Sequence[str] = FIELDS) -> DataFrame:
    """Full outer join of two catalogs on path; ``a_``/``b_`` columns and presence flags."""
    keys = [*by, "path"]
    left = a.select(*keys, F.lit(True).alias("in_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    right = b.select(*keys, F.lit(True).alias("in_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    return (left.join(right, keys, "full")
            .withColumn("in_a", F.coalesce("in_a", F.lit(False)))
            .withColumn("in_b", F.coalesce("in_b", F.lit(False))))


def facet_maps(facets: DataFrame) -> DataFrame:
    """(schema_id, type_name, facet, value) to one facet map per type."""
    return facets.groupBy("schema_id", "type_name").agg(
        F.map_from_entries(F.collect_list(F.struct("facet", "value"))).alias("facets"))


def facet_differences(a: Column, b: Column) -> Column:
    """Array of (facet, old, new) of two facet maps, enumeration left out, ordered by facet."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    rows = F.transform(names, lambda n: F.struct(
        n.alias("facet"), F.try_element_at(a, n).alias("old"), F.try_element_at(b, n).alias("new")))
    return F.filter(rows, lambda r: (r["facet"] != "enumeration") & ~r["old"].eqNullSafe(r["new"]))


def _facet_text(diffs: Column) -> Column:
    na = F.lit("N/A")
    return F.array_join(F.transform(diffs, lambda r: F.concat(
        r["facet"], F.lit(": "), F.coalesce(r["old"], na), F.lit(" → "), F.coalesce(r["new"], na))), "; ")


def with_type_facets(pairs: DataFrame, facets_a: DataFrame | None, facets_b: DataFrame | None) -> DataFrame:
    """Attach ``facet_diffs``: facet changes between the two named types of a changed field."""
    if facets_a is None or facets_b is None:
        return pairs.withColumn("facet_diffs", F.expr("cast(array() as array<struct<facet:string,old:string,new:string>>)"))
    a = facet_maps(facets_a).select(F.col("type_name").alias("a_type"), F.col("facets").alias("__fa"))
    b = facet_maps(facets_b).select(F.col("type_name").alias("b_type"), F.col("facets").alias("__fb"))
    joined = joins.dim_join(joins.dim_join(pairs, a, ["a_type"]), b, ["b_type"])
    return joined.withColumn("facet_diffs", facet_differences(F.col("__fa"), F.col("__fb"))).drop("__fa", "__fb")


def class_rule(before: Column, after: Column, part: int) -> Column:
    """Severity (2), direction (3) or impact (4) of a field-class transition."""
    out = F.lit(fixed.CLASS_OTHER[part - 2])
    for row in fixed.CLASS_TRANSITIONS:
        out = F.when((before == row[0]) & (after == row[1]), F.lit(row[part])).otherwise(out)
    return out


def _changes(right_name: str) -> Column:
    a, b = (lambda f: t.blank(f"a_{f}")), (lambda f: t.blank(f"b_{f}"))
    both = F.col("in_a") & F.col("in_b")
    path = F.col("path")

    def change(when, kind, severity, old, new, impact):
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(
            F.lit(kind).alias("change_type"), severity.alias("severity"), old.alias("old_value"),
            new.alias("new_value"), impact.alias("impact")))

    def differs(field):
        return both & (a(field) != b(field))

    def now(field, changed, new, removed):
        return (F.when((a(field) != "") & (b(field) != ""), changed)
                .when(b(field) != "", new).otherwise(removed))

    cls = lambda side: F.coalesce(F.col(f"{side}_field_class"), F.lit("NA"))
    details = _facet_text(F.col("facet_diffs"))
    arr = lambda side: F.coalesce(F.col(f"{side}_enums"), F.array().cast("array<string>"))
    gone = F.array_sort(F.array_distinct(F.array_except(arr("a"), arr("b"))))
    came = F.array_sort(F.array_distinct(F.array_except(arr("b"), arr("a"))))
    enum_text = lambda x: F.when(F.size(x) == 0, F.lit("None")).otherwise(F.array_join(x, ", "))
    cut = lambda c: t.or_none(t.truncate(c, 100, "..."))
    lit = F.lit

    return F.array_compact(F.array(
        change(~F.col("in_a"), "ADDED", "HIGH", lit("NOT PRESENT"), lit("PRESENT"),
               F.concat(lit("New field '"), path, lit(f"' added in {right_name}. May be required in new version."))),
        change(~F.col("in_b"), "REMOVED", "HIGH", lit("PRESENT"), lit("NOT PRESENT"),
               F.concat(lit("Field '"), path, lit(f"' removed in {right_name}. Breaking change if field was in use."))),
        change(differs("type"), "TYPE_CHANGED", "HIGH", a("type"), b("type"),
               F.concat(lit("Data type changed from '"), a("type"), lit("' to '"), b("type"),
                        lit("'. May require data conversion."),
                        F.when(details != "", F.concat(lit(" Restrictions: "), details)).otherwise(lit("")))),
        change(differs("min_occurs"), "CARDINALITY_CHANGED",
               F.when((a("min_occurs") == "0") & (b("min_occurs") != "0"), lit("HIGH")).otherwise(lit("MEDIUM")),
               F.concat(lit("min:"), a("min_occurs")), F.concat(lit("min:"), b("min_occurs")),
               F.when(b("min_occurs") != "0", lit("Field is now required.")).otherwise(lit("Field is now optional."))),
        change(differs("max_occurs"), "CARDINALITY_CHANGED", "MEDIUM",
               F.concat(lit("max:"), a("max_occurs")), F.concat(lit("max:"), b("max_occurs")),
               F.concat(lit("Max occurrences changed from "), a("max_occurs"), lit(" to "), b("max_occurs"), lit("."))),
        change(differs("restrictions"), "RESTRICTION_CHANGED", "HIGH", t.or_none(a("restrictions")),
               t.or_none(b("restrictions")), lit("Validation rules changed. May affect data validation.")),
        change(both & (cls("a") != cls("b")), "FIELD_CLASS_CHANGED", class_rule(cls("a"), cls("b"), 2),
               cls("a"), cls("b"), class_rule(cls("a"), cls("b"), 4)),
        change(differs("fixed"), "FIXED_VALUE_CHANGED", "HIGH", t.or_none(a("fixed")), t.or_none(b("fixed")),
               F.concat(lit("Fixed value changed from '"), t.or_none(a("fixed")), lit("' to '"),
                        t.or_none(b("fixed")), lit("'. Messages must use new fixed value."))),
        change(differs("dflt"), "DEFAULT_VALUE_CHANGED", "MEDIUM", t.or_none(a("dflt")), t.or_none(b("dflt")),
               F.concat(lit("Default value changed from '"), t.or_none(a("dflt")), lit("' to '"),
                        t.or_none(b("dflt")), lit("'."))),
        change(differs("rulebook"), "RULEBOOK_CHANGED", now("rulebook", lit("MEDIUM"), lit("MEDIUM"), lit("LOW")),
               cut(a("rulebook")), cut(b("rulebook")),
               now("rulebook", lit("Rulebook note changed. Review business requirements."),
                   F.concat(lit("New Rulebook note added: "), F.left(b("rulebook"), lit(100)), lit("...")),
                   lit("Rulebook note removed."))),
        change(differs("usage_rules"), "USAGE_RULES_CHANGED",
               now("usage_rules", lit("MEDIUM"), lit("MEDIUM"), lit("LOW")),
               cut(a("usage_rules")), cut(b("usage_rules")),
               now("usage_rules", lit("Usage rules changed. Review implementation requirements."),
                   lit("New usage rules added."), lit("Usage rules removed."))),
        change(both & (arr("a") != arr("b")), "ENUMERATION_CHANGED",
               F.when(F.size(gone) > 0, lit("HIGH")).when(F.size(came) > 0, lit("MEDIUM")).otherwise(lit("LOW")),
               enum_text(arr("a")), enum_text(arr("b")),
               F.when(F.size(gone) > 0, F.concat(lit("Enumeration values removed: "), F.array_join(gone, ", "),
                                                 lit(". Breaking change for existing data.")))
               .when(F.size(came) > 0, F.concat(lit("Enumeration values added: "), F.array_join(came, ", "),
                                                lit(". New values available.")))
               .otherwise(lit("Enumeration values changed."))),
    ))


def schema_diff(a: DataFrame, b: DataFrame, by: Sequence[str] = (), right_name: str = "the new version",
                facets_a: DataFrame | None = None, facets_b: DataFrame | None = None) -> DataFrame:
    """One row per change between two catalogs, with severity and impact.

    ``by`` names extra key columns present on both sides, for example a pair of versions.
    """
    pairs = pair_by_path(a, b, by)
    same = F.col("in_a") & F.col("in_b")
    for f in FIELDS[2:]:
        same = same & F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    # most fields of two versions agree; drop them before any text is built
    pairs = with_type_facets(pairs.filter(~same), facets_a, facets_b)
    side = lambda f: [t.blank(f"a_{f}").alias(f"left_{f}"), t.blank(f"b_{f}").alias(f"right_{f}")]
    return pairs.select(
        *by, "path", F.coalesce("a_tag", "b_tag").alias("element"),
        F.coalesce("a_seq", F.lit(0)).alias("seq_left"), F.coalesce("b_seq", F.lit(0)).alias("seq_right"),
        *side("type"), *side("min_occurs"), *side("max_occurs"),
        F.col("facet_diffs"), F.inline(_changes(right_name)))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every path with both sides and SAME, CHANGED, ADDED or REMOVED."""
    changed = F.lit(False)
    for f in ("type", "min_occurs", "max_occurs"):
        changed = changed | (t.blank(f"a_{f}") != t.blank(f"b_{f}"))
    return pair_by_path(a, b, fields=("seq", "tag", "type", "min_occurs", "max_occurs")).select(
        "path", F.coalesce("a_tag", "b_tag").alias("element"),
        *[t.blank(f"{s}_{f}").alias(f"{s}_{f}") for s in "ab" for f in ("type", "min_occurs", "max_occurs")],
        F.when(~F.col("in_b"), "REMOVED").when(~F.col("in_a"), "ADDED")
        .when(changed, "CHANGED").otherwise("SAME").alias("status"), "a_seq", "b_seq")


def facet_change_rows(diff: DataFrame) -> DataFrame:
    """One row per facet that differs between the two types of a TYPE_CHANGED field."""
    na = F.lit("N/A")
    return (diff.filter(F.col("change_type") == "TYPE_CHANGED")
            .select("path", "element", "left_type", "right_type", F.inline("facet_diffs"))
            .select("path", "element", "left_type", "right_type", F.col("facet").alias("restriction"),
                    F.coalesce("old", na).alias("old_value"), F.coalesce("new", na).alias("new_value")))


def enum_changes(diff: DataFrame) -> DataFrame:
    """Enumeration changes with the added and removed codes as sorted lists."""
    values = lambda c: F.when(F.col(c) == "None", F.array().cast("array<string>")).otherwise(F.split(c, ", "))
    shown = lambda x: F.when(F.size(x) == 0, F.lit("None")).otherwise(F.array_join(F.array_sort(x), ", "))
    old, new = values("old_value"), values("new_value")
    return diff.filter(F.col("change_type") == "ENUMERATION_CHANGED").select(
        "severity", "element", "path", "old_value", "new_value",
        shown(F.array_except(new, old)).alias("added"), shown(F.array_except(old, new)).alias("removed"), "impact")


def class_changes(diff: DataFrame) -> DataFrame:
    """Field-class changes with their direction."""
    return diff.filter(F.col("change_type") == "FIELD_CLASS_CHANGED").select(
        "severity", "element", "path", "old_value", "new_value",
        class_rule(F.col("old_value"), F.col("new_value"), 3).alias("direction"), "impact")


def change_examples(diff: DataFrame) -> DataFrame:
    """Before and after snippets of added, removed and re-typed elements."""
    tag = t.last_segment("path")
    kind = F.col("change_type")
    typed = lambda c: F.format_string("<%s><!-- %s --></%s>", tag, F.left(c, F.lit(30)), tag)
    return diff.filter(kind.isin("ADDED", "REMOVED", "TYPE_CHANGED")).select(
        "path", "change_type",
        F.when(kind == "REMOVED", F.format_string("<%s>sample_value</%s>", tag, tag))
        .when(kind == "ADDED", F.format_string("<!-- %s did not exist -->", tag))
        .otherwise(typed(F.col("left_type"))).alias("before"),
        F.when(kind == "REMOVED", F.format_string("<!-- %s removed -->", tag))
        .when(kind == "ADDED", F.format_string("<%s>new_value</%s>", tag, tag))
        .otherwise(typed(F.col("right_type"))).alias("after"))


def only_changes(df: DataFrame, column: str = "status", same: Sequence[str] = ("SAME", "UNCHANGED", "ALIGNED")) -> DataFrame:
    return df.filter(~F.col(column).isin(*same))


def search(df: DataFrame, text: str, facet: str = "all", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows containing ``text`` in any shown column and, unless 'all', of one severity or type."""
    columns = columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    shown = F.lower(F.concat_ws(" ", *columns))
    facet_ok = F.lit(True) if facet == "all" else (F.col("severity") == facet) | (F.col("change_type") == facet)
    return df.filter(facet_ok & shown.contains(text.lower()))


# ---- order -------------------------------------------------------------------------

def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "HIGH", 0).when(F.col(column) == "MEDIUM", 1).when(F.col(column) == "LOW", 2).otherwise(3)


def change_rank(column: str = "change_type") -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in fixed.CHANGE_TYPES]), F.col(column))


def _last_if_missing(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(LAST))


def order_by_severity(diff: DataFrame) -> DataFrame:
    return diff.orderBy(severity_rank(), change_rank(), "path")


def order_detail(diff: DataFrame) -> DataFrame:
    """Severity as text (HIGH, LOW, MEDIUM), then both sequence numbers."""
    return diff.orderBy("severity", "seq_left", "seq_right", "path")


def order_paths(rows: DataFrame, left: str = "seq_left", right: str = "seq_right") -> DataFrame:
    """Document order of the left side, then of the right side; missing positions last."""
    return rows.orderBy(_last_if_missing(left), _last_if_missing(right), "path")


def order_by_depth(rows: DataFrame) -> DataFrame:
    """Parents before children: shortest path first."""
    return rows.orderBy(F.length("path"), "path")


# ---- roll-ups ----------------------------------------------------------------------

def diff_stats(diff: DataFrame) -> DataFrame:
    """Count per change type, zero-filled, plus the total; one pass of conditional counts."""
    counts = [F.count_if(F.col("change_type") == c).alias(c) for c in fixed.CHANGE_TYPES]
    one = diff.agg(F.count("*").alias("TOTAL"), *counts)
    names = ["TOTAL", *fixed.CHANGE_TYPES]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("change_type"), F.col(n).alias("n")) for n in names])))


def severity_stats(diff: DataFrame) -> DataFrame:
    one = diff.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in fixed.SEVERITIES])))


def first_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """First ``n`` values per group as an array; the rank limit applies before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return (rows.select(*keys, *[F.col(o) for o in order if o not in keys], F.col(value).alias("__v"))
            .withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n)
            .groupBy(*keys)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__v"))), lambda s: s["__v"]).alias("sample")))


def changes_by_type(diff: DataFrame, n: int = 5) -> DataFrame:
    """Count and severities per change type with the first elements and '(+k more)'."""
    counts = diff.groupBy("change_type").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in fixed.SEVERITIES])
    # one row per change type on both sides, so this join is tiny at any scale
    first = first_per_group(diff, ["change_type"], ["path", "old_value"], "element", n)
    return counts.join(first, "change_type").select(
        "change_type", "n", "high", "medium", "low",
        F.concat(F.array_join("sample", ", "),
                 F.when(F.col("n") > n, F.format_string(" (+%d more)", F.col("n") - n)).otherwise("")).alias("samples"))


def pair_counts(diff: DataFrame, pair: str = "pair") -> DataFrame:
    """Totals per pair of versions and a grand total (pair 'TOTAL')."""
    return diff.rollup(pair).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("change_type") == c).alias(name) for c, name in
          (("ADDED", "added"), ("REMOVED", "removed"), ("FIELD_CLASS_CHANGED", "class_changes"))],
    ).withColumn(pair, F.coalesce(pair, F.lit("TOTAL")))


def directional_counts(diff: DataFrame, n: int = 10) -> DataFrame:
    """Upgraded, downgraded and newly mandatory fields: count and first paths."""
    label = (F.when((F.col("old_value") == "WHITE") & (F.col("new_value") == "YELLOW"), "upgraded")
             .when((F.col("old_value") == "YELLOW") & (F.col("new_value") == "WHITE"), "downgraded")
             .when((F.col("old_value") == "NA") & (F.col("new_value") == "YELLOW"), "newly_mandatory"))
    moved = (diff.filter(F.col("change_type") == "FIELD_CLASS_CHANGED")
             .withColumn("direction", label).filter(F.col("direction").isNotNull()))
    counts = moved.groupBy("direction").agg(F.count("*").alias("n"))
    first = first_per_group(moved, ["direction"], ["path"], "path", n)
    return counts.join(first, "direction").select("direction", "n", F.array_join("sample", ", ").alias("paths"))


def issue_rollup(diff: DataFrame, by: Sequence[str] = ("pair",), n: int = 5) -> DataFrame:
    """Per pair, severity and type: count, first paths and how many more."""
    keys = [*by, "severity", "change_type"]
    counts = diff.groupBy(*keys).agg(F.count("*").alias("n"))
    first = first_per_group(diff, keys, ["path", "old_value"], "path", n)
    return counts.join(first, keys).select(
        *keys, "n", F.concat(F.array_join("sample", ", "),
                             F.when(F.col("n") > n, F.format_string(" ... and %d more", F.col("n") - n)).otherwise("")).alias("paths"))
