"""Field mappings between two schemas, and messages migrated along them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import flatten as fl, joins

ROOT = "<root>"


def exact_path_map(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Paths present in both schemas, mapped to themselves."""
    both = src.select("path").join(dst.select("path").distinct(), "path", "left_semi").distinct()
    return both.select(F.col("path").alias("source_path"), F.col("path").alias("target_path"), F.lit("exact").alias("how"))


def similar_path_map(src: DataFrame, dst: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Nearest target of the same tag and depth for sources without an exact match.

    A path of n parts may differ from its target in k = n - ceil(threshold * n) of them, never in the last. Its other parts are dealt into k + 1
    blocks, so two paths within the threshold share a whole block: they meet by (depth, tag, number of the block, block) and the
    differing parts are counted there. Blocks take every (k + 1)-th part, since the first parts are the same in most paths of a schema. The best
    target has the fewest differing parts, then the smallest path.
    """
    alone = src.select("path").distinct().join(dst.select("path"), "path", "left_anti")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        parts = df.select(F.col("path").alias(name), F.split("path", "/").alias(f"{name}_parts")).withColumn("n", F.size(f"{name}_parts"))
        k = F.least(F.floor(F.col("n") * (1 - threshold) + 1e-9).cast("int"), F.col("n") - 1)
        inner = F.slice(f"{name}_parts", 1, F.col("n") - 1)
        # k + 1 blocks; a target is listed under the same ones
        block = F.transform(F.sequence(F.lit(0), F.col("k")), lambda j: F.struct(
            j.alias("j"), F.array_join(F.filter(inner, lambda _, i: F.pmod(i, F.col("k") + 1) == j), "/").alias("block")))
        return parts.withColumn("k", k).filter("k > 0").select(name, f"{name}_parts", "n", "k", F.element_at(f"{name}_parts", -1).alias("tag"), F.inline(block))

    left, right = blocks(alone, "source_path"), blocks(dst.select("path").distinct(), "target_path").drop("k")
    differing = F.size(F.filter(F.zip_with("source_path_parts", "target_path_parts", lambda a, b: a != b), lambda d: d))
    pairs = left.join(right, ["n", "tag", "j", "block"]).select("source_path", "target_path", "k", differing.alias("differing")).filter("differing <= k")
    best = pairs.groupBy("source_path").agg(F.min_by("target_path", F.struct("differing", "target_path")).alias("target_path"))
    return best.select("source_path", "target_path", F.lit("similar").alias("how"))


def build_mapping(src: DataFrame, dst: DataFrame, custom: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """Exact, then similar matches; custom pairs override both."""
    auto = exact_path_map(src, dst).unionByName(similar_path_map(src, dst, threshold))
    if custom is None:
        return auto
    own = custom.select("source_path", "target_path", F.lit("custom").alias("how"))
    return auto.join(own.select("source_path"), "source_path", "left_anti").unionByName(own)


def apply_mapping(values: DataFrame, mapping: DataFrame, target: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """(doc_id, target_path, source_path, value): mapped source value, else the same-path value.

    ``values`` has one value per document and path. When several sources map to a target the
    exact one, then the smallest source path wins.
    """
    wanted = target.select(F.col("path").alias("target_path"))
    mapped = joins.dim_join(values, mapping.select(F.col("source_path").alias("path"), "target_path"), ["path"], "inner")
    same = joins.dim_join(values.withColumn("target_path", F.col("path")), wanted, ["target_path"], "left_semi")
    rows = (mapped.select(doc_id, "target_path", F.col("path").alias("source_path"), "value", F.lit(0).alias("rank"))
            .unionByName(same.select(doc_id, "target_path", F.col("path").alias("source_path"), "value", F.lit(1).alias("rank"))))
    rows = joins.dim_join(rows, wanted, ["target_path"], "left_semi")
    best = rows.groupBy(doc_id, "target_path").agg(
        F.min_by(F.struct("source_path", "value"), F.struct("rank", F.col("source_path") != F.col("target_path"), "source_path")).alias("r"))
    return best.select(doc_id, "target_path", "r.source_path", "r.value")


def unmapped_sources(values: DataFrame, mapping: DataFrame, target: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Source values without a mapping and without a same-path target; attributes are skipped."""
    known = mapping.select(F.col("source_path").alias("path")).unionByName(target.select("path")).distinct()
    rows = values.filter(~F.col("path").contains("@"))
    return joins.dim_join(rows, known, ["path"], "left_anti").select(doc_id, "path", "value")


def _conditions(target: DataFrame) -> DataFrame:
    """Per target path the optional ancestors (and itself) whose values it depends on.

    A path whose whole chain is mandatory depends on the root alone.
    """
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nested = target.filter(F.size(parts) > 1).select("path", F.explode(chain).alias("needs"))
    optional = target.filter(F.col("min_occurs") == "0").select(F.col("path").alias("needs"))
    pairs = nested.join(optional, "needs", "left_semi")
    free = target.filter(F.size(parts) > 1).select("path").join(pairs.select("path"), "path", "left_anti").withColumn("needs", F.lit(ROOT))
    every = pairs.unionByName(free, allowMissingColumns=True)
    return every.withColumn("n_needs", F.count("*").over(W.partitionBy("path")))


def migrate(values: DataFrame, mapping: DataFrame, target: DataFrame, add_defaults: bool = True,
            now: datetime | None = None, doc_id: str = "msg_id") -> DataFrame:
    """Target rows per message: (doc_id, path, source_path, value, how, depth).

    A row exists when its parent exists and it has a value or is mandatory. Rows without a
    value get the default of their tag when there is one (``how`` = default), else stay empty.
    """
    now = now or datetime.now()
    mapped = apply_mapping(values, mapping, target, doc_id)
    facts = mapped.select(doc_id, F.col("target_path").alias("needs")).unionByName(
        values.select(doc_id).distinct().withColumn("needs", F.lit(ROOT)))
    reached = joins.dim_join(facts, _conditions(target), ["needs"], "inner")
    exists = reached.groupBy(doc_id, "path").agg(F.count("*").alias("n"), F.max("n_needs").alias("n_needs")).filter("n = n_needs")
    fill = {"stamp": now.strftime("%Y%m%d%H%M%S"), "now": now.strftime("%Y-%m-%dT%H:%M:%S"), "today": now.strftime("%Y-%m-%d")}
    defaults = F.create_map(*[F.lit(x) for k, v in fixed.MIGRATION_DEFAULTS.items() for x in (k, v.format(**fill))])
    default = F.try_element_at(defaults, t.last_segment("path")) if add_defaults else F.lit(None).cast("string")
    rows = exists.select(doc_id, "path").join(mapped.withColumnRenamed("target_path", "path"), [doc_id, "path"], "left")
    return rows.select(
        doc_id, "path", "source_path", F.coalesce("value", default).alias("value"),
        F.when(F.col("value").isNotNull(), "mapped").when(default.isNotNull(), "default").otherwise("empty").alias("how"),
        t.depth("path").alias("depth"))


# ---- whole messages against a target tree --------------------------------------------

MOST_CELLS = 100_000  # fields of messages that are moved at once
HOW = ("mapped", "default", "empty")
MOST_FIELDS = 50_000  # fields of a schema and of a mapping that travel as one row


@dataclass(frozen=True)
class TargetTree:
    """A target schema in preorder with what each field draws from; one row of a bounded number of fields.

    Field k spans ``enter`` = k to ``leave`` (the last field below it), so the fields above another one are those whose span holds it. Its
    ``needs`` are the optional ones among them, itself included; ``sources`` are places in ``paths``, best first.
    """

    paths: list[str]
    fields: list[tuple[str, int, list[int], list[int], str | None]]  # path, leave, sources, needs, default


def target_tree(mapping: DataFrame, target: DataFrame, add_defaults: bool = True, now: datetime | None = None) -> TargetTree:
    """The tree of ``target`` (path, min_occurs and, for the order of siblings, seq) with the sources of ``mapping``."""
    wanted = target.select("path", "min_occurs", *([F.col("seq")] if "seq" in target.columns else [F.lit(0).alias("seq")]))
    rows = {}
    for r in sorted(_fields(wanted, "target"), key=lambda r: (r["seq"] is None, r["seq"] or 0, r["path"])):
        rows.setdefault(r["path"], r)
    own: dict[str, set[str]] = {}
    for r in _fields(mapping.select("source_path", "target_path"), "mapping"):
        own.setdefault(r["target_path"], set()).add(r["source_path"])
    # exact, then by name, then the field's own path
    sources = {p: list(dict.fromkeys([*sorted(own.get(p, ()), key=lambda s: (s != p, s)), p])) for p in rows}
    paths = sorted({s for found in sources.values() for s in found} | {s for found in own.values() for s in found})
    at = {p: k for k, p in enumerate(paths)}
    now = now or datetime.now()
    fill = {"stamp": now.strftime("%Y%m%d%H%M%S"), "now": now.strftime("%Y-%m-%dT%H:%M:%S"), "today": now.strftime("%Y-%m-%d")}
    defaults = {tag: text.format(**fill) for tag, text in fixed.MIGRATION_DEFAULTS.items()} if add_defaults else {}
    order = _preorder(list(rows))
    leave = list(range(len(order)))
    open_: list[int] = []
    fields = []
    for k, path in enumerate(order):
        while open_ and not path.startswith(order[open_[-1]] + "/"):
            leave[open_.pop()] = k - 1
        open_.append(k)
        needs = [j for j in open_ if rows[order[j]]["min_occurs"] == "0" and "/" in order[j]]
        fields.append((path, k, [at[s] for s in sources[path]], needs, defaults.get(path.rsplit("/", 1)[-1])))
    for k in open_:
        leave[k] = len(order) - 1
    return TargetTree(paths, [(p, leave[k], s, n, d) for p, k, s, n, d in fields])


def _fields(df: DataFrame, name: str) -> list:
    found = df.limit(MOST_FIELDS + 1).collect()
    if len(found) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields in the {name}: use leaf_map and migrate, which join them")
    return found


def _preorder(paths: list[str]) -> list[str]:
    """Paths so that what is below a path follows it at once; siblings stay in the given order."""
    known = set(paths)
    children: dict[str | None, list[str]] = {}
    for path in paths:
        above = path
        while "/" in above:
            above = above.rsplit("/", 1)[0]
            if above in known:
                break
        else:
            above = None
        children.setdefault(above, []).append(path)
    out, todo = [], list(reversed(children.get(None, [])))
    while todo:
        path = todo.pop()
        out.append(path)
        todo += reversed(children.get(path, []))
    return out


def move(messages: DataFrame, tree: TargetTree, doc_id: str = "msg_id", xml: str = "xml") -> DataFrame:
    """(doc_id, fields array<struct<path, source_path, value, how, present>>, unmapped array<struct<path, value>>), a row a message.

    A message meets the whole tree in one map: a field takes the first of its sources that has a value and is present when every optional field
    whose span holds it has one. Nothing is shuffled. Many messages are moved at once, field by field.
    """
    schema = (f"{doc_id} {messages.schema[doc_id].dataType.simpleString()}, fields array<struct<path: string, source_path: string, value: string, how: string, present: boolean>>, "
              "unmapped array<struct<path: string, value: string>>")
    at = {p: k for k, p in enumerate(tree.paths)}
    step = max(1, MOST_CELLS // max(len(tree.paths), len(tree.fields), 1))

    def run(batches):
        paths, names = pa.array(tree.paths, pa.string()), pa.array([f[0] for f in tree.fields], pa.string())
        fallback = np.array([f[4] for f in tree.fields], dtype=object)
        filled = np.array([d is not None for d in fallback], dtype=bool)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, step):
                owner, found = [], []
                for i, text in enumerate(texts.slice(start, step).to_pylist(), start):
                    values = fl.leaf_values(text)
                    if values:
                        owner.append(i)
                        found.append(values)
                if found:
                    yield moved(ids.take(pa.array(owner, pa.int64())), found, paths, names, fallback, filled)

    def moved(ids, found, paths, names, fallback, filled):
        n, wide = len(found), len(tree.fields)
        vals = np.full((n, len(tree.paths)), None, dtype=object)
        ends, left_path, left_value = [0], [], []
        for i, values in enumerate(found):
            for path, value in values.items():
                k = at.get(path)
                if k is not None:
                    vals[i, k] = value
                elif "@" not in path:
                    left_path.append(path)
                    left_value.append(value)
            ends.append(len(left_path))
        has = np.not_equal(vals, None).astype(bool)
        hits = np.full((n, wide), -1)
        for k, (_, _, sources, _, _) in enumerate(tree.fields):
            for s in reversed(sources):
                hits[has[:, s], k] = s
        hit = hits >= 0
        present = np.empty((n, wide), dtype=bool)
        for k, (path, _, _, needs, _) in enumerate(tree.fields):
            present[:, k] = hit[:, needs].all(axis=1) if "/" in path else False
        value = np.where(hit, vals[np.arange(n)[:, None], np.maximum(hits, 0)], fallback)
        how = np.where(hit, 0, np.where(filled, 1, 2))
        fields = pa.StructArray.from_arrays([
            names.take(pa.array(np.tile(np.arange(wide), n))), paths.take(pa.array(hits.ravel(), mask=~hit.ravel())), pa.array(value.ravel(), pa.string()),
            pa.array(HOW, pa.string()).take(pa.array(how.ravel())), pa.array(present.ravel())], ["path", "source_path", "value", "how", "present"])
        unmapped = pa.StructArray.from_arrays([pa.array(left_path, pa.string()), pa.array(left_value, pa.string())], ["path", "value"])
        lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in ((np.arange(n + 1) * wide, fields), (ends, unmapped))]
        return pa.RecordBatch.from_arrays([ids, *lists], ["id", "fields", "unmapped"])

    return messages.select(doc_id, xml).mapInArrow(run, schema)


def moved_values(moved: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """(doc_id, target_path, source_path, value) of every field with a value of the message, as ``apply_mapping`` gives them."""
    rows = moved.select(doc_id, F.inline(F.expr("filter(fields, f -> f.how = 'mapped')")))
    return rows.select(doc_id, F.col("path").alias("target_path"), "source_path", "value")


def moved_rows(moved: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Target rows per message, as ``migrate`` gives them."""
    rows = moved.select(doc_id, F.inline(F.expr("filter(fields, f -> f.present)")))
    return rows.select(doc_id, "path", "source_path", "value", "how", t.depth("path").alias("depth"))


def moved_leftovers(moved: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    return moved.select(doc_id, F.inline("unmapped"))


def moved_stats(moved: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Actions per message, counted inside its row; messages without an action are left out."""
    of = lambda how: F.size(F.expr(f"filter(fields, f -> f.present and f.how = '{how}')")).cast("bigint")
    counts = moved.select(doc_id, of("mapped").alias("mapped"), of("default").alias("defaults"), F.size("unmapped").cast("bigint").alias("not_mapped"))
    total = F.col("mapped") + F.col("defaults") + F.col("not_mapped")
    return counts.select(doc_id, total.alias("total"), "mapped", "defaults", "not_mapped").filter("total > 0")


def moved_messages(moved: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Migrated messages as XML text, elements in the order of the tree."""
    return fl.render_leaves(moved, F.expr("transform(filter(fields, f -> f.present), f -> struct(f.path as path, f.value as value))"), doc_id)


def actions(migrated: DataFrame, unmapped: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Mapped, default and removed actions with source and target."""
    none = F.lit(None).cast("string")
    done = migrated.filter(F.col("how") != "empty").select(
        doc_id, F.col("how").alias("action"), "source_path", F.col("path").alias("target_path"), F.col("value").alias("target_value"))
    gone = unmapped.select(doc_id, F.lit("removed").alias("action"), F.col("path").alias("source_path"), F.lit("").alias("target_path"), none.alias("target_value"))
    return done.unionByName(gone)


def transform_stats(rows: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    return rows.groupBy(doc_id).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(n) for a, n in
                                       (("mapped", "mapped"), ("default", "defaults"), ("removed", "not_mapped"))])


def rebuilt_messages(migrated: DataFrame, target: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Migrated rows as XML text, elements in the order of the target schema (``seq``)."""
    from fieldlens.operators.flatten import rebuild_xml

    placed = joins.dim_join(migrated, target.select("path", "seq"), ["path"])
    return rebuild_xml(placed, doc_id, order="seq")
