"""API specifications: one document per nation, one path per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.operators import apispec as ap, guides as gd, trees as tr
from fieldlens.registry import Group
from fieldlens.session import checkpoint

GROUP = Group()

_SHARED = ('"Base": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "format": "int64", "readOnly": true}, '
           '"link": {"$ref": "#/components/schemas/Link", "description": "override"}, "gone": {"$ref": "other.yaml#/X"}}}, '
           '"Link": {"type": "object", "description": "orig", "properties": {"href": {"type": "string", "pattern": "^h"}, "next": {"$ref": "#/components/schemas/Link"}}}')


def spec_docs(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    key, name = F.col("k").cast("string"), F.col("n")
    ref = F.concat(F.lit('{"$ref": "#/components/schemas/S'), key, F.lit('"}'))
    get = F.concat(
        F.lit('"get": {"summary": "'), name, F.lit('", "tags": ["t'), (F.col("k") % 3).cast("string"), F.lit('", "x"], "parameters": [{"name": "id", "in": "query", "required": true, "schema": {"type": "string", "maxLength": '), key,
        F.lit('}}, {"$ref": "#/components/parameters/Page"}], "responses": {"404": {"description": "none"}, "200": {"description": "ok", "content": {"application/json": {"schema": {"type": "array", "items": '), ref,
        F.lit('}}, "text/plain": {"schema": {"type": "string"}}}}}}'))
    post = F.when(F.col("k") % 2 == 0, F.concat(
        F.lit(', "post": {"description": "make it", "requestBody": {"content": {"application/json": {"schema": '), ref, F.lit('}}}, "responses": {"201": {"description": "made"}}}'))).otherwise("")
    path = F.concat(F.lit('"/s/{'), key, F.lit('}/items": {'), get, post, F.lit("}"))
    schema = F.concat(
        F.lit('"S'), key, F.lit('": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "example": "'), name,
        F.lit('", "enum": ["A", "B"]}, "tags": {"type": "array", "items": {"type": "string", "nullable": true}}, "parts": {"type": "array", "items": {"type": "object", "properties": {"no": {"type": "integer", "minimum": '), key, F.lit('}}}}}}]}'))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("v")))), lambda x: x["v"]), ", ")
    per = s.groupBy("doc_id").agg(ordered(path).alias("paths"), ordered(schema).alias("schemas"))
    text = F.concat(F.lit('{"openapi": "3.0.0", "paths": {'), "paths", F.lit('}, "components": {"parameters": {"Page": {"name": "page", "in": "query", "description": "page no", "schema": {"type": "integer", "default": 1}}}, "schemas": {'),
                    "schemas", F.lit(", " + _SHARED + "}}}"))
    return per.select("doc_id", text.alias("json"))


def _spec(spark, sf_dir):
    return checkpoint(ap.spec_nodes(tr.flatten_json(spec_docs(spark, sf_dir), "doc_id", "json", raw=True)), sized=False)


S = "s as (select s_nationkey as doc_id, s_suppkey as k, s_name as n from supplier)"
EPS = f"""{S}, ep as (select doc_id, k, n, 'GET' as method, concat('/s/{{', k, '}}/items') as url_path, n as summary, concat('t', k % 3) as tag from s
  union all select doc_id, k, n, 'POST', concat('/s/{{', k, '}}/items'), 'make it', '' from s where k % 2 = 0)"""
# fields of S<k> below its root, with the path of each
FIELDS = """f as (select * from (values ('id', 'id', 'integer', 'Yes', 0), ('link', 'link', 'object', 'No', 0), ('href', 'link.href', 'string', 'No', 1), ('next', 'link.next', 'object', 'No', 1),
  ('href', 'link.next.href', 'string', 'No', 2), ('gone', 'gone', '', 'No', 0), ('name', 'name', 'string', 'Yes', 0), ('tags', 'tags', 'array', 'No', 0), ('tags[]', 'tags[]', 'string', 'No', 1),
  ('parts', 'parts', 'array', 'No', 0), ('parts[]', 'parts[]', 'object', 'No', 1), ('no', 'parts[].no', 'integer', 'No', 2)) x(field_name, path, type, required, depth))"""


@GROUP.add("api_endpoints", f"with {EPS}\nselect doc_id, concat(method, ':', url_path) as id, method, url_path, summary, tag, concat(method, '  ', url_path, '  —  ', left(summary, 60)) as label from ep")
def api_endpoints(spark, sf_dir):
    return ap.endpoints(_spec(spark, sf_dir)).drop("op", "pos")


@GROUP.add("api_contributions", f"""with {S}
select doc_id, concat('/components/schemas/S', k) as schema, count(*) as n from s cross join (values (1), (2), (3), (4)) x group by 1, 2""")
def api_contributions(spark, sf_dir):
    c = ap.contributions(_spec(spark, sf_dir)).filter(F.col("schema").rlike("^/components/schemas/S[0-9]+$"))
    return c.groupBy("doc_id", "schema").agg(F.count("*").alias("n"))


@GROUP.add("api_merged_properties", f"with {S}, {FIELDS}\nselect doc_id, concat('/components/schemas/S', k) as schema, field_name as name, required = 'Yes' as required from s cross join f where depth = 0")
def api_merged_properties(spark, sf_dir):
    spec = _spec(spark, sf_dir)
    rows = ap.merged_properties(spec, ap.contributions(spec)).filter(F.col("schema").rlike("^/components/schemas/S[0-9]+$"))
    return rows.select("doc_id", "schema", "name", "required")


@GROUP.add("api_walk_schema", f"""with {S}, {FIELDS}
select doc_id, concat('/components/schemas/S', k) as schema, field_name, path as full_path, type, required, depth, case when path = 'name' then n else '' end as example, case when path = 'name' then 'A | B' else '' end as enum,
  case when path like 'parts%no' then cast(k as varchar) else '' end as minimum, case when path = 'link' then 'override' when path like '%next' then 'orig' else '' end as description,
  case when path = 'id' then 'Yes' else 'No' end as "readOnly", case when path = 'tags[]' then 'Yes' else 'No' end as nullable from s cross join f""")
def api_walk_schema(spark, sf_dir):
    spec = _spec(spark, sf_dir)
    roots = spec.filter(F.col("pointer").rlike("^/components/schemas/S[0-9]+$")).select("doc_id", F.col("pointer").alias("schema"))
    return ap.walk_schema(spec, roots).select("doc_id", "schema", "field_name", "full_path", "type", "required", "depth", "example", "enum", "minimum", "description", "readOnly", "nullable")


ROWS = f"""{S}, {FIELDS}, e as (
select doc_id, concat('GET:/s/{{', k, '}}/items') as endpoint, 'Parameter (query)' as section, '[query] id' as full_path, 'Yes' as required, 'string' as type, '' as description from s
union all select doc_id, concat('GET:/s/{{', k, '}}/items'), 'Parameter (query)', '[query] page', 'No', 'integer', 'page no' from s
union all select doc_id, concat('GET:/s/{{', k, '}}/items'), 'Response 404', 'Response 404', '', '', 'none' from s
union all select doc_id, concat('GET:/s/{{', k, '}}/items'), 'Response 200 (application/json)', '[]', 'No', 'object', '' from s
union all select doc_id, concat('GET:/s/{{', k, '}}/items'), 'Response 200 (application/json)', concat('[].', path), required, type, case when path = 'link' then 'override' when path like '%next' then 'orig' else '' end from s cross join f
union all select doc_id, concat('POST:/s/{{', k, '}}/items'), 'Request Body (application/json)', path, required, type, case when path = 'link' then 'override' when path like '%next' then 'orig' else '' end from s cross join f where k % 2 = 0
union all select doc_id, concat('POST:/s/{{', k, '}}/items'), 'Response 201', 'Response 201', '', '', 'made' from s where k % 2 = 0)"""


def _rows(spark, sf_dir):
    spec = _spec(spark, sf_dir)
    return ap.endpoint_rows(spec, ap.endpoints(spec))


@GROUP.add("api_endpoint_rows", f"with {ROWS}\nselect * from e")
def api_endpoint_rows(spark, sf_dir):
    return ap.order_status_codes(_rows(spark, sf_dir)).select("doc_id", "endpoint", "section", "full_path", "required", "type", "description")


@GROUP.add("api_field_totals", f"with {ROWS}\nselect coalesce(cast(doc_id as varchar), 'TOTAL') as doc_id, coalesce(endpoint, 'TOTAL') as endpoint, count(*) as n_fields from e group by rollup (doc_id, endpoint)")
def api_field_totals(spark, sf_dir):
    return ap.field_totals(_rows(spark, sf_dir))


@GROUP.add("api_match_endpoints", f"with {EPS}\nselect doc_id, concat(method, ':', url_path) as id from ep where concat(method, ':', url_path) in ('GET:/s/{{1}}/items', 'POST:/s/{{2}}/items')".replace("{{1}}", "{1}").replace("{{2}}", "{2}"))
def api_match_endpoints(spark, sf_dir):
    return gd.match_keys(ap.endpoints(_spec(spark, sf_dir)), ["GET:/s/{1}/items", "POST:/s/{2}/items"], "id").select("doc_id", "id")
