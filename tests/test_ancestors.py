"""Ancestors of matching nodes."""

from __future__ import annotations

from fieldlens.operators import trees as tr


def test_kept_ancestors_never_pass_through_the_driver(spark):
    """the semi join with the ids of all kept nodes was a broadcast."""
    docs = spark.createDataFrame([(1, '{"a": {"b": "x", "c": 2}}'), (1, '{"a": {"b": 1}}')], "doc int, text string")
    kept = tr.filter_node_type(tr.flatten_json(docs, "doc", "text"), "string", "doc")
    small = spark.createDataFrame([(1, 0, [], "object"), (1, 1, [0], "string")], "doc int, node_id int, ancestors array<int>, type string")
    plan = tr.filter_node_type(small, "string", "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    # rows of a repeated document id are kept together with their twins, as before
    assert sorted((r["doc"], r["path"]) for r in kept.collect()) == [(1, "a"), (1, "a"), (1, "a.b"), (1, "a.b")]
