"""Hierarchies: path expansion over edges, JSON nodes, filters that keep ancestors, code sets."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldlens.operators import joins
from fieldlens.session import checkpoint

LEVELS = (4, 8)  # levels of the first stored round over a small graph, and of each later one
CHILDREN = 10_000  # children of a parent that are met in one place; those of a larger one are dealt over several


def expand_paths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, mode: str = "skip", by: Sequence[str] = (),
                 sep: str = "/", carry: Sequence[str] = (), repeat: str = "step", most_edges: int = joins.DIM_ROWS) -> DataFrame:
    """Every path reachable from the roots: (by, carry, path, node, depth, sort_key, circular, edge_id).

    ``edges`` is (by, parent, child, pos), ``roots`` (by, node, pos) and the ``carry`` columns, which every path of a root keeps. Optional
    ``label`` names a step in the path when it is not the node itself (an element and its type); optional ``edge_id`` is handed
    through. A (label, node), or with ``repeat`` = node a node, met again on its own path is left out (``skip``) or kept as a flagged leaf
    (``circular``), so the walk ends by itself when a round finds nothing new; there is no depth limit unless ``max_depth`` sets one.

    Over up to ``most_edges`` edges a round takes several levels in one job, children of a parent being one row of the graph sent to every task.
    Beyond that a round is one level, joined by node, and the children of a parent with more than ``CHILDREN`` are dealt over several
    places. Every round is stored and starts from the rows that the one before it found.
    """
    extra = lambda df, name, default: F.col(name) if name in df.columns else default
    edge_id = lambda df: extra(df, "edge_id", F.lit(None)).cast("bigint").alias("edge_id")
    step = lambda label, node: F.coalesce(node, F.lit("")) if repeat == "node" else F.concat_ws("\u0001", label, F.coalesce(node, F.lit("")))
    by, carry = list(by), list(carry)
    label = extra(edges, "label", F.col("child"))
    links = edges.select(*by, F.col("parent").alias("node"), F.struct(
        F.col("child").alias("child"), F.col("pos").cast("bigint").alias("pos"), label.alias("label"), edge_id(edges), step(label, F.col("child")).alias("step")).alias("c"))
    links = checkpoint(links, sized=False)
    label = extra(roots, "label", F.col("node"))
    rows = roots.select(
        *by, *carry, label.alias("path"), "node", F.lit(0).alias("depth"), F.array(F.col("pos").cast("bigint")).alias("sort_key"),
        F.array(step(label, F.col("node"))).alias("visited"), F.lit(False).alias("circular"), edge_id(roots), F.lit(max_depth is None or max_depth > 0).alias("open"))
    walk = _walk_small if joins.is_small(links, most_edges) else _walk_large
    return walk(rows, links, by, _below([*by, *carry], sep, max_depth), mode == "skip").drop("visited", "open")


def _below(kept: Sequence[str], sep: str, max_depth: int | None) -> str:
    """SQL of the row below a row along its edge ``c``."""
    again, quoted = "array_contains(visited, c.step)", sep.replace("\\", "\\\\").replace("'", "\\'")
    deeper = "" if max_depth is None else f" and depth + 1 < {int(max_depth)}"
    return (f"struct({''.join(f'`{k}`, ' for k in kept)}concat(path, '{quoted}', c.label) as path, c.child as node, depth + 1 as depth, concat(sort_key, array(c.pos)) as sort_key, "
            f"concat(visited, array(c.step)) as visited, {again} as circular, c.edge_id as edge_id, not {again}{deeper} as open)")


def _walk_small(rows: DataFrame, links: DataFrame, by: Sequence[str], below: str, skip: bool) -> DataFrame:
    graph = F.broadcast(checkpoint(links.groupBy(*by, F.col("node").alias("at")).agg(F.collect_list("c").alias("children"))))  # at most most_edges edges
    self = f"struct({', '.join(f'`{n}`' for n in rows.columns[:-1])}, false as open)"
    fresh = "filter(children, c -> not array_contains(visited, c.step))" if skip else "children"
    step = f"inline(concat(array({self}), transform(coalesce({fresh}, array()), c -> {below})))"
    level, out, levels = rows, None, LEVELS[0]
    while True:
        for _ in range(levels):
            level = level.selectExpr("*", "if(open, node, null) as at").join(graph, [*by, "at"], "left").selectExpr(step)
        level = checkpoint(level)
        done = level.filter("not open")
        out = done if out is None else out.unionByName(done)
        level = level.filter("open")
        if level.isEmpty():
            return out
        levels = LEVELS[1]


def _walk_large(rows: DataFrame, links: DataFrame, by: Sequence[str], below: str, skip: bool) -> DataFrame:
    on = [*by, "node"]
    many = checkpoint(links.groupBy(*on).count().filter(F.col("count") > CHILDREN).withColumn("places", F.ceil(F.col("count") / CHILDREN).cast("int")).drop("count"))
    hot = not many.isEmpty()
    if hot:
        place = F.coalesce(F.pmod(F.xxhash64("c.child", "c.label", "c.pos"), F.col("places")).cast("int"), F.lit(0))
        links = checkpoint(joins.dim_join(links, many, on).withColumn("place", place).drop("places"))
    out = level = rows
    while True:
        met = level.filter("open").drop("edge_id")
        if hot:
            met = joins.dim_join(met, many, on).withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1))).drop("places")
        met = met.join(links, [*on, "place"] if hot else on)
        met = met.filter("not array_contains(visited, c.step)") if skip else met
        level = checkpoint(met.selectExpr(f"inline(array({below}))"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


# ---- JSON --------------------------------------------------------------------------

JSON_FIELDS = (("node_id", "int"), ("parent_id", "int"), ("key", "string"), ("path", "string"), ("depth", "int"), ("type", "string"),
               ("value", "string"), ("child_count", "int"), ("extra", "string"), ("ancestors", "array<int>"), ("pointer", "string"), ("raw", "string"))
_ARROW = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _json_type(v) -> str:
    # booleans are integers in Python, so they are told apart first
    for kind, name in ((type(None), "null"), (bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array")):
        if isinstance(v, kind):
            return name
    return "object"


_INVALID = (0, None, "", "", 0, "invalid", None, 0, "", [], "", None)


def _whole_json(text: str | None, raw: bool) -> list[tuple]:
    """Rows of a document; one ``invalid`` row when it cannot be read, nested too deep included."""
    try:
        return list(_json_rows(json.loads(text), raw))
    except (TypeError, ValueError, RecursionError):
        return [_INVALID]


def _json_rows(data, raw: bool):
    top = _json_kids(data, "") if isinstance(data, (dict, list)) else [("root", data, "root", "root")]
    next_id = 0
    stack = [(None, k, v, p, 0, [], f"/{e}") for k, v, p, e in reversed(top)]
    while stack:
        parent, key, value, path, depth, ancestors, pointer = stack.pop()
        kind, node_id = _json_type(value), next_id
        next_id += 1
        kids, extra, shown = [], "", ""
        if kind in ("object", "array"):
            kids = _json_kids(value, path)
            extra = f"{len(kids)} {'keys' if kind == 'object' else 'items'}"
        else:
            shown = str(value)
        yield (node_id, parent, key, path, depth, kind, shown, len(kids), extra, ancestors, pointer,
               json.dumps(value, ensure_ascii=False) if raw else None)
        stack.extend((node_id, k, v, p, depth + 1, [*ancestors, node_id], f"{pointer}/{e}") for k, v, p, e in reversed(kids))


def _json_kids(value, path: str) -> list[tuple]:
    """(key, value, path, pointer part) of the members of an object or a list; a key that looks like an index stays a key."""
    if isinstance(value, dict):
        return [(str(k), v, f"{path}.{k}" if path else str(k), str(k).replace("~", "~0").replace("/", "~1")) for k, v in value.items()]
    return [(f"[{i}]", v, f"{path}[{i}]", str(i)) for i, v in enumerate(value)]


def flatten_json(df: DataFrame, doc_id: str, text: str, raw: bool = False) -> DataFrame:
    """One row per JSON value in document order: key, path, depth, type, value, child count, pointer.

    Values are whole; reports cut what they show. Unreadable text gives one row of type ``invalid``. ``raw`` adds each
    value as JSON text; meant for specifications, where examples are shown in full.
    """
    id_type = df.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {id_type}, " + ", ".join(f"`{n}` {t}" for n, t in JSON_FIELDS)

    def run(batches):
        for batch in batches:
            ids, owner, rows = batch.column(0), [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = _whole_json(value, raw)
                owner.extend([i] * len(found))
                rows += found
                if len(rows) >= 20_000:
                    yield _batch(ids, owner, rows)
                    owner, rows = [], []
            if rows:
                yield _batch(ids, owner, rows)

    def _batch(ids, owner, rows):
        arrays = [ids.take(pa.array(owner, pa.int64()))]
        arrays += [pa.array(list(c), _ARROW[t]) for (_, t), c in zip(JSON_FIELDS, zip(*rows))]
        return pa.RecordBatch.from_arrays(arrays, ["id", *[n for n, _ in JSON_FIELDS]])

    return df.select(doc_id, text).mapInArrow(run, schema)


def variant_type(v: Column) -> Column:
    """JSON type name of a VARIANT, without Python."""
    kind = F.schema_of_variant(v)
    return (F.when(v.isNull() | F.is_variant_null(v), "null").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer")
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number").when(kind == "STRING", "string")
            .when(kind.startswith("ARRAY"), "array").otherwise("object"))


def root_rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Top level of JSON texts: keys of an object, ``[i]`` of an array, ``root`` of a scalar, type ``invalid`` for unreadable text."""
    every = df.select(doc_id, F.try_parse_json(F.col(text)).alias("v"))
    parsed = every.filter(F.col("v").isNotNull())
    unreadable = every.filter(F.col("v").isNull()).select(doc_id, F.lit("root").alias("key"), F.lit("invalid").alias("type"))
    container = variant_type(F.col("v")).isin("object", "array")
    opened = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    inner = opened.select(doc_id, F.coalesce("key", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).alias("key"), variant_type(F.col("value")).alias("type"))
    scalar = parsed.filter(~container).select(doc_id, F.lit("root").alias("key"), variant_type(F.col("v")).alias("type"))
    return inner.unionByName(scalar).unionByName(unreadable)


def json_stats(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    kinds = ("object", "array", "string", "integer", "number", "boolean", "null")
    return nodes.groupBy(*by).agg(
        F.count("*").alias("total_nodes"), F.count_if(F.col("child_count") == 0).alias("total_leaves"), F.max("depth").alias("max_depth"),
        *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds])


def largest_arrays(nodes: DataFrame, doc_id: str, k: int = 20) -> DataFrame:
    return (nodes.filter(F.col("type") == "array").select(doc_id, "path", F.col("child_count").alias("size"))
            .orderBy(F.desc("size"), doc_id, "path").limit(k))


def top_keys(nodes: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent keys, index keys left out; ties by name."""
    # the step of an array item is written as an index in its path, that of a key never follows its parent without a dot
    index = F.col("key").rlike(r"^\[\d+\]$") & ~F.col("pointer").endswith(F.concat(F.lit("/"), "key"))
    return (nodes.filter(~index).groupBy("key").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "key").limit(k))


def with_ancestors(nodes: DataFrame, match: Column, doc_id: str) -> DataFrame:
    """Matching nodes plus every ancestor of one (``node_id`` and ``ancestors`` columns)."""
    hits = nodes.filter(match)
    keep = hits.select(doc_id, F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id")).distinct()
    # as many rows as there are nodes, though narrow ones: they never travel through the driver
    return nodes.join(keep.hint("merge"), [doc_id, "node_id"], "left_semi")


def filter_node_type(nodes: DataFrame, kind: str, doc_id: str) -> DataFrame:
    """Nodes of a JSON type (number also takes integer) with their ancestors."""
    return with_ancestors(nodes, F.col("type").isin("number", "integer") if kind == "number" else F.col("type") == kind, doc_id)


def paths_with_ancestors(rows: DataFrame, match: Column, by: Sequence[str] = (), sep: str = "/") -> DataFrame:
    """Rows whose path matches or is a prefix of a matching path."""
    parts = F.split("path", sep)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    keep = rows.filter(match).select(*by, F.explode(prefixes).alias("path")).distinct()
    return rows.join(keep, [*by, "path"], "left_semi")


def filter_kind(rows: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Catalog rows of a kind (column ``node_type``) with their ancestors; ``all`` keeps every row."""
    return rows if kind == "all" else paths_with_ancestors(rows, F.col("node_type") == kind, by)


def filter_cardinality(rows: DataFrame, view: str, by: Sequence[str] = ()) -> DataFrame:
    """Catalog rows that are ``optional`` (may be absent) or ``unbounded`` (may repeat without end) with their ancestors."""
    if view not in ("optional", "unbounded"):
        raise ValueError(f"no view of cardinality: {view}")
    return paths_with_ancestors(rows, F.col("min_occurs") == "0" if view == "optional" else F.col("max_occurs") == "unbounded", by)


# ---- code sets ---------------------------------------------------------------------

def code_valid(values: DataFrame, codes: DataFrame, on: Sequence[str] = ("code_set", "code")) -> DataFrame:
    """Values with a flag telling whether the code belongs to its set."""
    return joins.dim_join(values, codes.select(*on, F.lit(True).alias("__ok")).distinct(), on).withColumn(
        "valid", F.coalesce("__ok", F.lit(False))).drop("__ok")


def code_lookup(codes: DataFrame, code_set: str) -> DataFrame:
    return codes.filter(F.col("code_set") == code_set).orderBy("pos")


def code_set_exists(names: DataFrame, codes: DataFrame) -> DataFrame:
    """Names (column ``code_set``) with a flag telling whether such a set exists."""
    return code_valid(names, codes, ("code_set",)).withColumnRenamed("valid", "present")


def code_set_names(codes: DataFrame) -> DataFrame:
    """Distinct names of the code sets."""
    return codes.select("code_set").distinct()


def first_code(codes: DataFrame) -> DataFrame:
    return codes.groupBy("code_set").agg(F.min_by("code", "pos").alias("code"), F.count("*").alias("n_codes"))
