"""API specifications as joins on JSON pointers: endpoints, references, merged schemas, field rows.

``spec`` is the node table of ``flatten_json(.., raw=True)``. A schema is known by its
pointer; what a reference or a composite contributes to it is a relation (schema ->
contributing pointers, in order of precedence), computed once for all schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators.trees import expand_paths
from fieldlens.session import checkpoint

COMPOSITES = ("allOf", "anyOf", "oneOf")
FIELDS = ("type", "format", "nullable", "description", "title", "example", "x-example", "default", "minimum", "minLength", "maximum",
          "maxLength", "pattern", "readOnly", "writeOnly", "deprecated")


def spec_nodes(nodes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Spec nodes with the pointer of their parent."""
    return nodes.select(doc_id, "node_id", "key", "pointer", F.regexp_replace("pointer", "/[^/]*$", "").alias("parent"), "type", "value", "raw", "child_count")


def endpoints(spec: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per path and method: id, label, summary (or description), first tag."""
    parts = F.split("pointer", "/")
    ops = spec.filter((F.size(parts) == 4) & (parts[1] == "paths") & F.lower(parts[3]).isin(*fixed.HTTP_METHODS) & (F.col("type") == "object")).select(
        doc_id, F.col("pointer").alias("op"), F.upper(parts[3]).alias("method"), t.pointer_unescape(parts[2]).alias("url_path"), F.col("node_id").alias("pos"))
    child = lambda key, name: spec.filter(F.col("key") == key).select(doc_id, F.col("parent").alias("op"), F.get_json_object(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "$.v").alias(name))
    tags = spec.filter(F.col("pointer").endswith("/tags/0")).select(doc_id, F.regexp_replace("pointer", "/tags/0$", "").alias("op"), F.col("value").alias("tag"))
    rows = ops.join(child("summary", "s"), [doc_id, "op"], "left").join(child("description", "d"), [doc_id, "op"], "left").join(tags, [doc_id, "op"], "left")
    summary = F.coalesce("s", "d", F.lit(""))
    return rows.select(
        doc_id, "op", "pos", F.concat("method", F.lit(":"), "url_path").alias("id"), "method", "url_path", summary.alias("summary"), F.coalesce("tag", F.lit("")).alias("tag"),
        F.concat("method", F.lit("  "), "url_path", F.when(summary != "", F.concat(F.lit("  —  "), F.left(summary, F.lit(60)))).otherwise("")).alias("label"))


def _pointer_of(ref: Column) -> Column:
    return F.when(ref.startswith("#/"), F.substr(ref, F.lit(2)))


def contributions(spec: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(schema, pointer, rank, own_props): every pointer that adds to a schema, in order of precedence.

    A schema's own keys come first, then its reference, then its composites. References outside
    the document add nothing. ``own_props`` is false where the referrer's own properties
    replace those of its target.
    """
    refs = spec.filter(F.col("key") == "$ref").select(doc_id, "parent", _pointer_of(F.col("value")).alias("child"), F.lit(0).alias("pos"))
    props = spec.filter(F.col("key") == "properties").select(doc_id, "parent").withColumn("replaced", F.lit(True))
    refs = refs.filter(F.col("child").isNotNull()).join(props, [doc_id, "parent"], "left").withColumn("label", F.when(F.col("replaced"), "replaced").otherwise("ref")).drop("replaced")
    kw, index = F.regexp_extract("pointer", r"/(allOf|anyOf|oneOf)/\d+$", 1), F.regexp_extract("pointer", r"/(\d+)$", 1)
    parts = spec.filter(kw != "").select(
        doc_id, F.regexp_replace("pointer", r"/(allOf|anyOf|oneOf)/\d+$", "").alias("parent"), F.col("pointer").alias("child"),
        (F.array_position(F.array(*[F.lit(c) for c in COMPOSITES]), kw) * 1_000_000 + index.cast("int")).alias("pos"), F.lit("part").alias("label"))
    schemas = spec.filter(F.col("type") == "object").select(doc_id, F.col("pointer").alias("schema"), F.col("pointer").alias("node"), F.lit(0).alias("pos"), F.lit("self").alias("label"))
    plain = schemas.join(refs.unionByName(parts).select(doc_id, F.col("parent").alias("schema")).distinct(), [doc_id, "schema"], "left_anti")
    linked = schemas.join(plain.select(doc_id, "schema"), [doc_id, "schema"], "left_anti")
    edges = refs.unionByName(parts)
    starts = linked.select(doc_id, "schema", "node", "pos", "label")
    found = expand_paths(edges, starts, by=(doc_id,), carry=("schema",), repeat="node")
    walked = found.select(doc_id, "schema", F.col("node").alias("pointer"), F.col("sort_key").alias("rank"), (~F.col("path").contains("/replaced")).alias("own_props"))
    own = plain.select(doc_id, "schema", F.col("schema").alias("pointer"), F.array(F.lit(0).cast("bigint")).alias("rank"), F.lit(True).alias("own_props"))
    return checkpoint(own.unionByName(walked), sized=False)


def field_columns(spec: DataFrame, contrib: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Resolved columns per schema pointer: the first contributor that has a key wins."""
    keys = spec.filter(F.col("key").isin(*FIELDS, "enum", "properties")).select(doc_id, F.col("parent").alias("pointer"), "key", "value", "raw", "type")
    text = F.when(F.col("type").isin("object", "array"), F.col("raw")).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "$.v"))
    text = F.when(F.col("type") == "boolean", F.col("value")).when(F.col("type") == "null", F.lit(None)).otherwise(text)
    rows = contrib.join(keys.withColumn("text", text), [doc_id, "pointer"])
    # one aggregate for all keys: a column of its own for each would be a plan of thousands of lines, for the driver and for every task
    first = rows.groupBy(doc_id, "schema", "key").agg(F.min_by("text", "rank").alias("text"), F.bool_or("own_props").alias("own_props"))
    whole = first.groupBy(doc_id, "schema").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("texts"), F.bool_or((F.col("key") == "properties") & F.col("own_props")).alias("has_properties"))
    wide = whole.select(doc_id, "schema", *[F.try_element_at("texts", F.lit(k)).alias(k) for k in (*FIELDS, "enum")], "has_properties")
    yes = lambda c: t.yes_no(F.coalesce(F.col(c), F.lit("")) == "True").alias(c)
    blank = lambda *c: F.coalesce(*[F.col(x) for x in c], F.lit(""))
    return wide.select(
        doc_id, "schema", F.coalesce("type", F.when(F.col("has_properties"), "object").otherwise("")).alias("type"), blank("format").alias("format"), yes("nullable"),
        blank("description", "title").alias("description"), F.coalesce(F.array_join(F.from_json("enum", "array<string>"), " | "), F.lit("")).alias("enum"),
        blank("example", "x-example").alias("example"), blank("default").alias("default"), blank("minimum", "minLength").alias("minimum"),
        blank("maximum", "maxLength").alias("maximum"), blank("pattern").alias("pattern"), yes("readOnly"), yes("writeOnly"), yes("deprecated"), "has_properties")


def required_names(spec: DataFrame, contrib: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(schema, name) of every required name, united over all contributors."""
    names = spec.filter(F.col("pointer").rlike(r"/required/\d+$")).select(doc_id, F.regexp_replace("pointer", r"/required/\d+$", "").alias("pointer"), F.col("value").alias("name"))
    return contrib.join(names, [doc_id, "pointer"]).select(doc_id, "schema", "name").distinct()


def merged_properties(spec: DataFrame, contrib: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(schema, name, property, pos, required): united properties; of one name the last contributor's counts."""
    props = spec.filter(F.regexp_extract("parent", "/([^/]*)$", 1) == "properties").select(
        doc_id, F.regexp_replace("parent", "/properties$", "").alias("pointer"), F.col("key").alias("name"), F.col("pointer").alias("property"), "node_id")
    rows = contrib.filter("own_props").join(props, [doc_id, "pointer"])
    best = rows.groupBy(doc_id, "schema", "name").agg(F.max_by("property", "rank").alias("property"), F.min(F.struct("rank", "node_id")).alias("first"))
    flags = required_names(spec, contrib, doc_id).withColumn("required", F.lit(True))
    return best.join(flags, [doc_id, "schema", "name"], "left").select(
        doc_id, "schema", "name", "property", F.col("first.node_id").alias("pos"), F.coalesce("required", F.lit(False)).alias("required"))


def child_of(pointers: DataFrame, spec: DataFrame, contrib: DataFrame, key: str, out: str, doc_id: str = "doc_id") -> DataFrame:
    """Pointer of a named child of each ``schema`` pointer, looked up through its contributors."""
    kids = spec.filter(F.col("key") == key).select(doc_id, F.col("parent").alias("pointer"), F.col("pointer").alias("kid"))
    found = pointers.select(doc_id, "schema").distinct().join(contrib, [doc_id, "schema"]).join(kids, [doc_id, "pointer"])
    return found.groupBy(doc_id, "schema").agg(F.min_by("kid", "rank").alias(out))


def walk_schema(spec: DataFrame, roots: DataFrame, doc_id: str = "doc_id", max_depth: int | None = None, contrib: DataFrame | None = None,
                cols: DataFrame | None = None) -> DataFrame:
    """Field rows under root schemas (doc_id, schema): dotted paths, ``[]`` item rows, required flag, columns.

    A property met again on its own path is not opened again.
    """
    contrib = contributions(spec, doc_id) if contrib is None else contrib
    cols = checkpoint(field_columns(spec, contrib, doc_id), sized=False) if cols is None else cols
    props = merged_properties(spec, contrib, doc_id).select(
        doc_id, F.col("schema").alias("parent"), F.col("property").alias("child"), F.concat(F.lit("."), "name").alias("label"), F.col("pos"), "required")
    arrays = cols.filter((F.col("type") == "array") & ~F.col("has_properties"))
    items = child_of(arrays, spec, contrib, "items", "child", doc_id).select(
        doc_id, F.col("schema").alias("parent"), "child", F.lit("[]").alias("label"), F.lit(0).alias("pos"), F.lit(False).alias("required"))
    edges = checkpoint(props.unionByName(items).withColumn("edge_id", F.xxhash64("parent", "label")), sized=False)
    starts = roots.select(doc_id, F.col("schema").alias("node"), F.lit("").alias("label"), F.lit(0).alias("pos"), F.col("schema").alias("root")).distinct()
    paths = expand_paths(edges, starts, max_depth, by=(doc_id,), sep="", carry=("root",))
    named = edges.select(doc_id, F.col("child").alias("node"), "edge_id", "required", F.col("label").alias("step"))
    full = F.regexp_replace("path", r"^\.", "")
    rows = paths.filter("depth > 0").join(named, [doc_id, "node", "edge_id"]).filter(~F.col("path").rlike(r"[^\[\]]\[\]\[\]"))
    info = cols.withColumnRenamed("schema", "node")
    item = F.col("step") == "[]"
    holder = F.regexp_extract(full, r"([^.\[\]]+)\[\]$", 1)
    return rows.join(info, [doc_id, "node"], "left").select(
        doc_id, F.col("root").alias("schema"), F.when(item, F.concat(F.when(holder == "", "items").otherwise(holder), F.lit("[]"))).otherwise(F.substr("step", F.lit(2))).alias("field_name"),
        full.alias("full_path"), (F.col("depth") - 1).alias("depth"), item.alias("is_array_item"), t.yes_no(F.col("required")).alias("required"), "sort_key",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("type", "format", "description", "enum", "example", "default", "minimum", "maximum", "pattern")],
        *[F.coalesce(c, F.lit("No")).alias(c) for c in ("nullable", "readOnly", "writeOnly", "deprecated")])


def endpoint_rows(spec: DataFrame, eps: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Parameters, request body and responses of every endpoint as field rows with a section label.

    Of several media types the first is used. A response without a body gives a placeholder row.
    """
    contrib = contributions(spec, doc_id)
    ops = eps.select(doc_id, "op", F.col("id").alias("endpoint"))
    under = lambda key: F.concat("op", F.lit("/" + key))

    def with_children(rows: DataFrame, scalars: dict[str, str], kids: dict[str, str]) -> DataFrame:
        """Values of scalar children of ``schema`` and pointers of others, by key, looked up together through its contributors."""
        wanted = spec.filter(F.col("key").isin(*scalars, *kids)).select(doc_id, F.col("parent").alias("pointer"), "key", F.col("value").alias("v"), F.col("pointer").alias("kid"))
        found = rows.select(doc_id, "schema").distinct().join(contrib, [doc_id, "schema"]).join(wanted, [doc_id, "pointer"])
        of = lambda key, c: F.min_by(F.when(F.col("key") == key, F.col(c)), F.when(F.col("key") == key, F.col("rank")))
        picked = [of(key, "v").alias(out) for key, out in scalars.items()] + [of(key, "kid").alias(out) for key, out in kids.items()]
        return rows.join(found.groupBy(doc_id, "schema").agg(*picked), [doc_id, "schema"], "left")

    def first_media(rows: DataFrame) -> DataFrame:
        """schema := schema pointer of the first media type of ``content``; rows without a body keep null."""
        media = spec.select(doc_id, F.col("parent").alias("content"), "node_id", "key", "pointer").groupBy(doc_id, "content").agg(F.min_by(F.struct("key", "pointer"), "node_id").alias("m"))
        body = spec.filter(F.col("key") == "schema").select(doc_id, F.col("parent").alias("media_pointer"), F.col("pointer").alias("body"))
        placed = rows.join(media, [doc_id, "content"], "left").withColumn("media", F.col("m.key")).withColumn("media_pointer", F.col("m.pointer")).drop("m")
        return placed.join(body, [doc_id, "media_pointer"], "left")

    # parameters
    params = spec.filter(F.col("pointer").rlike(r"/parameters/\d+$")).select(
        doc_id, F.regexp_replace("pointer", r"/parameters/\d+$", "").alias("op"), F.col("pointer").alias("schema"), F.col("node_id").alias("pos")).join(ops, [doc_id, "op"])
    params = checkpoint(with_children(params, {"name": "name", "in": "location", "required": "req", "description": "about"}, {"schema": "own"}), sized=False)
    cols = checkpoint(field_columns(spec, contrib, doc_id), sized=False)
    own = cols.withColumnRenamed("schema", "own").drop("has_properties")
    texts = ("type", "format", "enum", "example", "default", "minimum", "maximum", "pattern")
    flags = ("nullable", "readOnly", "writeOnly", "deprecated")
    place, name = t.blank("location"), t.blank("name")
    p_rows = params.join(own, [doc_id, "own"], "left").select(
        doc_id, "endpoint", F.lit(0).alias("part"), F.lit("").alias("code"), F.array(F.col("pos").cast("bigint")).alias("sort_key"), name.alias("field_name"),
        F.concat(F.lit("["), place, F.lit("] "), name).alias("full_path"), t.yes_no(t.blank("req") == "True").alias("required"), F.coalesce("about", "description", F.lit("")).alias("description"),
        F.concat(F.lit("Parameter ("), place, F.lit(")")).alias("section"), F.lit(0).alias("depth"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts], *[F.coalesce(c, F.lit("No")).alias(c) for c in flags])

    # bodies
    req = spec.select(doc_id, F.col("pointer").alias("schema")).join(ops.withColumn("schema", under("requestBody")), [doc_id, "schema"]).withColumn("part", F.lit(1)).withColumn("code", F.lit(""))
    resp = spec.filter(F.col("pointer").rlike(r"/responses/[^/]+$")).select(
        doc_id, F.regexp_replace("pointer", r"/responses/[^/]+$", "").alias("op"), F.col("pointer").alias("schema"), F.col("key").alias("code")).join(ops, [doc_id, "op"]).withColumn("part", F.lit(2))
    both = req.select(doc_id, "endpoint", "schema", "part", "code").unionByName(resp.select(doc_id, "endpoint", "schema", "part", "code"))
    bodies = checkpoint(first_media(with_children(both, {"description": "about"}, {"content": "content"})), sized=False)
    label = F.concat(F.when(F.col("part") == 1, "Request Body").otherwise(F.concat(F.lit("Response "), "code")))
    walked = walk_schema(spec, bodies.filter("body is not null").select(doc_id, F.col("body").alias("schema")), doc_id, contrib=contrib, cols=cols)
    b_rows = bodies.select(doc_id, "endpoint", "part", "code", "media", F.col("body").alias("schema")).join(walked, [doc_id, "schema"]).select(
        doc_id, "endpoint", "part", "code", "sort_key", "field_name", "full_path", "required", "description",
        F.concat(label, F.lit(" ("), "media", F.lit(")")).alias("section"), "depth", *texts, *flags)
    none = F.lit("")
    empty = bodies.filter("part = 2 and content is null").select(
        doc_id, "endpoint", "part", "code", F.array().cast("array<bigint>").alias("sort_key"), F.concat(F.lit("["), "code", F.lit("]")).alias("field_name"),
        F.concat(F.lit("Response "), "code").alias("full_path"), none.alias("required"), t.blank("about").alias("description"),
        F.concat(F.lit("Response "), "code").alias("section"), F.lit(0).alias("depth"), *[none.alias(c) for c in (*texts, *flags)])
    return p_rows.unionByName(b_rows).unionByName(empty)


def order_status_codes(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Parameters, request body, then responses by status code as text; fields in document order."""
    return rows.orderBy(doc_id, "endpoint", "part", "code", "sort_key")


def field_totals(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Fields per endpoint, per document (endpoint 'TOTAL') and overall."""
    return rows.rollup(doc_id, "endpoint").agg(F.count("*").alias("n_fields")).select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("TOTAL")).alias(doc_id), F.coalesce("endpoint", F.lit("TOTAL")).alias("endpoint"), "n_fields")
