"""Resolved columns of API schemas."""

from __future__ import annotations

import json

from fieldlens.operators import apispec as ap, trees as tr

DOC = {"paths": {"/a": {"get": {"summary": "s", "parameters": [{"$ref": "#/components/parameters/P"}, {"name": "q", "in": "query", "required": True, "schema": {"type": "string", "enum": ["A", "B"]}}],
                                "responses": {"200": {"description": "ok", "content": {"j": {"schema": {"$ref": "#/components/schemas/S"}}}}, "404": {"$ref": "#/components/responses/N"}}}}},
       "components": {"parameters": {"P": {"name": "page", "in": "query", "description": "no", "schema": {"type": "integer", "default": 1}}}, "responses": {"N": {"description": "none"}},
                      "schemas": {"S": {"allOf": [{"$ref": "#/components/schemas/B"}, {"description": "own", "nullable": True, "example": {"k": 1}, "minimum": None}]},
                                  "B": {"type": "object", "description": "base", "properties": {"id": {"type": "integer", "format": "int64"}}}}}}


def _spec(spark):
    docs = spark.createDataFrame([(1, json.dumps(DOC))], "doc_id int, json string")
    return ap.spec_nodes(tr.flatten_json(docs, "doc_id", "json", raw=True)).cache()


def test_columns_of_all_keys_are_one_aggregate(spark):
    """F7, F8: a pair of aggregates for every key made plans that filled the driver."""
    spec = _spec(spark)
    contrib = ap.contributions(spec)
    cols = ap.field_columns(spec, contrib)
    assert cols._jdf.queryExecution().optimizedPlan().toString().count("min_by(") == 1
    got = {r["schema"]: r for r in cols.collect()}
    s, q = got["/components/schemas/S"], got["/paths/~1a/get/parameters/1/schema"]
    assert (s["type"], s["description"], s["nullable"], json.loads(s["example"]), s["minimum"], s["has_properties"]) == ("object", "base", "Yes", {"k": 1}, "", True)
    assert (q["type"], q["enum"], q["has_properties"]) == ("string", "A | B", False)


def test_children_looked_up_together(spark):
    spec = _spec(spark)
    rows = ap.endpoint_rows(spec, ap.endpoints(spec)).select("section", "full_path", "required", "type", "description").collect()
    assert sorted(map(tuple, rows)) == [
        ("Parameter (query)", "[query] page", "No", "integer", "no"), ("Parameter (query)", "[query] q", "Yes", "string", ""),
        ("Response 200 (j)", "id", "No", "integer", ""), ("Response 404", "Response 404", "", "", "none")]


def test_parsed_nodes_are_not_taken_for_small(spark, tmp_path):
    """F7, F8: thousands of nodes had the size of the text file they came from, and were broadcast."""
    from fieldlens.session import checkpoint

    spark.createDataFrame([(1, json.dumps(DOC))], "doc_id int, json string").write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    nodes = ap.spec_nodes(tr.flatten_json(read, "doc_id", "json", raw=True))
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    kept = checkpoint(nodes, sized=False)
    assert size(checkpoint(nodes)) < 1 << 20 < 1 << 40 < size(kept)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, nodes.collect()))
    joined = kept.join(kept.select("doc_id", "parent").distinct(), ["doc_id", "parent"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
