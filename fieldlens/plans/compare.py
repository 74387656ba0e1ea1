"""Whole comparisons: the report sheets a user gets from two schemas, many schemas, or two guides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fieldlens.operators import guides as gd, schema_diff as sd, versions as vs, xsd


def compare_schemas(a: DataFrame, b: DataFrame, right_name: str = "the new version", facets_a: DataFrame | None = None,
                    facets_b: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sheets of a two-schema comparison. All of them read one change table."""
    diff = sd.schema_diff(a, b, right_name=right_name, facets_a=facets_a, facets_b=facets_b)
    kind = F.col("change_type")
    return {
        "Summary": sd.diff_stats(diff), "Severity": sd.severity_stats(diff), "All Differences": sd.order_detail(diff.drop("facet_diffs")),
        "Side by Side": sd.side_by_side(a, b), "Added": diff.filter(kind == "ADDED").drop("facet_diffs"), "Removed": diff.filter(kind == "REMOVED").drop("facet_diffs"),
        "Type Restrictions": sd.facet_change_rows(diff), "Field Classification": sd.class_changes(diff), "Enumerations": sd.enum_changes(diff),
        "Examples": sd.change_examples(diff), "Changes by Type": sd.changes_by_type(diff),
    }


def compare_documents(docs: DataFrame, left: str, right: str, mode: str = "derived_only") -> dict[str, DataFrame]:
    """Schema documents straight to a comparison of two of them."""
    from fieldlens.session import checkpoint

    nodes = checkpoint(xsd.schema_nodes(docs.filter(F.col("schema_id").isin(left, right))))
    catalog = checkpoint(xsd.full_catalog(nodes, mode))
    facets = xsd.facets(nodes, xsd.type_table(nodes)).select("schema_id", "type_name", "facet", "value").filter("facet <> 'enumeration'")
    side = lambda df, s: df.filter(F.col("schema_id") == s)
    return compare_schemas(side(catalog, left), side(catalog, right), right, side(facets, left), side(facets, right))


def compare_versions(catalog: DataFrame, schema_ids: Sequence[str]) -> dict[str, DataFrame]:
    """Sheets over several versions: matrix, evolution, consecutive differences and their roll-ups."""
    diffs = vs.consecutive_diffs(catalog, vs.pair_consecutive(vs.schema_list(catalog.filter(F.col("schema_id").isin(*schema_ids)))))
    return {
        "Matrix": vs.matrix(catalog, schema_ids), "Field Classifications": vs.evolution(catalog, schema_ids), "Change Summary": vs.change_summary(catalog, diffs),
        "Pairs": sd.pair_counts(diffs), "Issues": sd.issue_rollup(diffs), "Classes": vs.class_counts(catalog), "Differences": diffs.drop("facet_diffs"),
    }


def compare_guides(a: DataFrame, b: DataFrame, a_label: str = "EPC", b_label: str = "NPC", by: Sequence[str] = ("message",)) -> dict[str, DataFrame]:
    """Sheets of a guide comparison. Where rows carry their position ``pos``, the last row of a repeated xpath counts."""
    diff = gd.guide_diff(a, b, by)
    rows = diff.select(*by, "xpath", "change", gd.what_changed().alias("what_changed"), gd.guide_impact(a_label, b_label).alias("impact"),
                       gd.context_value("tag").alias("tag"), gd.context_value("mult").alias("mult"))
    return {"Differences": rows, "Summary": gd.sheet_stats(diff, by[0])} if by else {"Differences": rows}


def cross_reference(catalog: DataFrame, guide: DataFrame) -> dict[str, DataFrame]:
    """Sheets of a schema-against-guide analysis."""
    rows = gd.cross_reference(catalog, guide)
    return {
        "Summary": gd.gap_stats(rows), "All Fields": rows, "Gaps Only": sd.only_changes(rows, "gap"), "Excluded by Scheme": gd.by_gap(rows, "EXCLUDED"),
        "Mandatory Checklist": gd.mandatory_checklist(rows), "Conditional Fields": gd.conditional_fields(rows), "XSD Only": gd.by_gap(rows, "XSD_ONLY"),
    }
