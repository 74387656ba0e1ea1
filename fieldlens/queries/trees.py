"""Hierarchies, JSON nodes and code sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.operators import trees as tr
from fieldlens.queries.base import catalog
from fieldlens.registry import Group

GROUP = Group()


def _edges(spark, sf_dir):
    edges = fx.frame(spark, sf_dir, "edges")
    roots = fx.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_regionkey").alias("pos"))
    return edges, roots


@GROUP.add("expand_paths", fx.oracle("edges", """
, r as (select concat('R', r_regionkey) as n from region)
select n as path, 0 as depth from r
union all select concat(n, '/', e1.child), 1 from r join edges e1 on e1.parent = n
union all select concat(n, '/', e1.child, '/', e2.child), 2 from r join edges e1 on e1.parent = n join edges e2 on e2.parent = e1.child
union all select concat(n, '/', e1.child, '/', e2.child, '/', e3.child), 3 from r join edges e1 on e1.parent = n join edges e2 on e2.parent = e1.child join edges e3 on e3.parent = e2.child""".replace("\n, r", "with r", 1).lstrip()))
def expand_paths(spark, sf_dir):
    edges, roots = _edges(spark, sf_dir)
    return tr.expand_paths(edges, roots).select("path", "depth")


@GROUP.add("expand_circular", fx.oracle("edges", """
with r as (select concat('R', r_regionkey) as n from region),
t as (select n as path, n as node from r union all select concat(n, '/', e1.child), e1.child from r join edges e1 on e1.parent = n)
select path, false as circular from t
union all select concat(n, '/', e1.child, '/', n), true from r join edges e1 on e1.parent = n"""))
def expand_circular(spark, sf_dir):
    """Regions and nations, with an edge back from every nation to its region."""
    edges, roots = _edges(spark, sf_dir)
    down = edges.filter(F.col("parent").startswith("R"))
    back = down.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(0).alias("pos"))
    return tr.expand_paths(down.unionByName(back), roots, mode="circular").select("path", "circular")


# ---- JSON: every order as a document with its lines as an array --------------------

def _order_docs(spark, sf_dir):
    lines = fx.frame(spark, sf_dir, "numbered_lines").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), (F.col("l_returnflag") == "R").alias("returned")))).alias("lines"))
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status")).alias("head"), "lines"))
    return orders.join(lines, "o_orderkey").select(F.col("o_orderkey").alias("doc"), doc.alias("text"))


def _nodes(spark, sf_dir):
    return tr.flatten_json(_order_docs(spark, sf_dir), "doc", "text")


JSON = """n as (select l_orderkey as doc, l_linenumber - 1 as i, l_partkey, l_returnflag from numbered_lines), c as (select doc, count(*) as k from n group by 1),
j as (select doc, 'id' as path, 'id' as key, 0 as depth, 'integer' as type, cast(doc as varchar) as value, 0 as child_count from c
 union all select doc, 'head', 'head', 0, 'object', '', 1 from c union all select doc, 'head.status', 'status', 1, 'string', o_orderstatus, 0 from c join orders on o_orderkey = doc
 union all select doc, 'lines', 'lines', 0, 'array', '', k from c
 union all select doc, concat('lines[', i, ']'), concat('[', i, ']'), 1, 'object', '', 3 from n
 union all select doc, concat('lines[', i, '].no'), 'no', 2, 'integer', cast(i + 1 as varchar), 0 from n union all select doc, concat('lines[', i, '].part'), 'part', 2, 'integer', cast(l_partkey as varchar), 0 from n
 union all select doc, concat('lines[', i, '].returned'), 'returned', 2, 'boolean', case when l_returnflag = 'R' then 'True' else 'False' end, 0 from n)"""


def _j(body: str) -> str:
    return fx.oracle("numbered_lines", f"with {JSON}\n{body}")


@GROUP.add("flatten_json", _j("select doc, path, key, depth, type, value, child_count from j"))
def flatten_json(spark, sf_dir):
    return _nodes(spark, sf_dir).select("doc", "path", "key", "depth", "type", "value", "child_count")


@GROUP.add("flatten_events", """
select event_id, 'k' as path, 'integer' as type, cast(json_extract(props, '$.k') as varchar) as value from events""")
def flatten_events(spark, sf_dir):
    return tr.flatten_json(fx.table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "path", "type", "value")


@GROUP.add("json_root_rows", "select event_id, 'k' as key, 'integer' as type from events")
def json_root_rows(spark, sf_dir):
    return tr.root_rows(fx.table(spark, sf_dir, "events"), "event_id", "props")


@GROUP.add("json_stats", _j("""select doc % 10 as bucket, count(*) as total_nodes, count(*) filter (child_count = 0) as total_leaves, max(depth) as max_depth, count(*) filter (type = 'object') as n_object, count(*) filter (type = 'array') as n_array,
  count(*) filter (type = 'string') as n_string, count(*) filter (type = 'integer') as n_integer, count(*) filter (type = 'number') as n_number, count(*) filter (type = 'boolean') as n_boolean, count(*) filter (type = 'null') as n_null from j group by 1"""))
def json_stats(spark, sf_dir):
    return tr.json_stats(_nodes(spark, sf_dir).withColumn("bucket", F.col("doc") % 10), ["bucket"])


@GROUP.add("largest_arrays", _j("select doc, path, child_count as size from j where type = 'array' order by child_count desc, doc, path limit 20"))
def largest_arrays(spark, sf_dir):
    return tr.largest_arrays(_nodes(spark, sf_dir), "doc")


@GROUP.add("top_keys", _j("select key, count(*) as n from j where not starts_with(key, '[') group by 1 order by n desc, key limit 4"))
def top_keys(spark, sf_dir):
    return tr.top_keys(_nodes(spark, sf_dir), 4)


@GROUP.add("filter_node_type", _j("""
select 'string' as kind, doc, path from j where path in ('head', 'head.status') union all
select 'number', doc, path from j where type = 'integer' or path = 'lines' or (type = 'object' and depth = 1)"""))
def filter_node_type(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    one = lambda k: tr.filter_node_type(nodes, k, "doc").select(F.lit(k).alias("kind"), "doc", "path")
    return one("string").unionByName(one("number"))


@GROUP.add("level_cut", _j("select doc, path from j where depth < 1"))
def level_cut(spark, sf_dir):
    return _nodes(spark, sf_dir).filter("depth < 1").select("doc", "path")


@GROUP.add("filter_cardinality", fx.oracle("cat_v2", """
select path from cat_v2 a where max_occurs = 'unbounded' or exists (select 1 from cat_v2 b where b.max_occurs = 'unbounded' and starts_with(b.path, concat(a.path, '/')))"""))
def filter_cardinality(spark, sf_dir):
    return tr.filter_cardinality(catalog(spark, sf_dir, "cat_v2"), "unbounded").select("path")


def _reached(match: str) -> str:
    """Rows of all versions that match or lie above a match of their version."""
    return f"""select schema_id, path from c semi join (
    select schema_id, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as path
    from c where {match}) up using (schema_id, path)"""


@GROUP.add("filter_optional", fx.oracle("cat_all", f"with c as (select * from cat_all)\n{_reached("min_occurs = '0'")}"))
def filter_optional(spark, sf_dir):
    return tr.filter_cardinality(catalog(spark, sf_dir, "cat_all"), "optional", ["schema_id"]).select("schema_id", "path")


@GROUP.add("filter_kind", fx.oracle("cat_all", f"""
with c as (select schema_id, path, case when tag = 'New' or k % 5 = 0 then 'attribute' else 'element' end as node_type from cat_all)
select 'attribute' as kind, * from ({_reached("node_type = 'attribute'")}) union all select 'all', schema_id, path from c"""))
def filter_kind(spark, sf_dir):
    """Attributes with the elements above them, in every version; all rows beside them."""
    kind = F.when((F.col("tag") == "New") | (F.col("k") % 5 == 0), "attribute").otherwise("element")
    rows = fx.frame(spark, sf_dir, "cat_all").withColumn("node_type", kind)
    one = lambda k: tr.filter_kind(rows, k, ["schema_id"]).select(F.lit(k).alias("kind"), "schema_id", "path")
    return one("attribute").unionByName(one("all"))


# ---- code sets ---------------------------------------------------------------------

@GROUP.add("code_valid", fx.oracle("code_dim", """
select c_custkey, n_name as code, r.r_name as code_set, n_regionkey = r.r_regionkey as valid from customer join nation on c_nationkey = n_nationkey join region r on r.r_regionkey = c_custkey % 5"""))
def code_valid(spark, sf_dir):
    codes = fx.frame(spark, sf_dir, "code_dim")
    region = fx.table(spark, sf_dir, "region").select(F.col("r_name").alias("code_set"), F.col("r_regionkey").cast("bigint").alias("bucket"))
    nation = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("code"), F.col("n_nationkey").alias("c_nationkey"))
    values = fx.table(spark, sf_dir, "customer").withColumn("bucket", F.col("c_custkey") % 5).join(region, "bucket").join(nation, "c_nationkey")
    return tr.code_valid(values.select("c_custkey", "code", "code_set"), codes)


@GROUP.add("code_lookup", fx.oracle("code_dim", "select pos, code from code_dim where code_set = 'ASIA'"))
def code_lookup(spark, sf_dir):
    return tr.code_lookup(fx.frame(spark, sf_dir, "code_dim"), "ASIA").select("pos", "code")


@GROUP.add("code_set_exists", fx.oracle("code_dim", "select distinct c_mktsegment as code_set, false as present from customer union all select r_name, true from region"))
def code_set_exists(spark, sf_dir):
    names = fx.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("code_set")).distinct().unionByName(
        fx.table(spark, sf_dir, "region").select(F.col("r_name").alias("code_set")))
    return tr.code_set_exists(names, fx.frame(spark, sf_dir, "code_dim"))


@GROUP.add("code_set_names", fx.oracle("code_dim", "select distinct code_set from code_dim"))
def code_set_names(spark, sf_dir):
    return tr.code_set_names(fx.frame(spark, sf_dir, "code_dim"))


@GROUP.add("first_code", fx.oracle("code_dim", "select code_set, arg_min(code, pos) as code, count(*) as n_codes from code_dim group by 1"))
def first_code(spark, sf_dir):
    return tr.first_code(fx.frame(spark, sf_dir, "code_dim"))
