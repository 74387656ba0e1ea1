"""Differences between two versions of the same messages: from their texts, or from node tables that exist already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlens.functions import text as t
from fieldlens.operators.flatten import differing_nodes, node_summary
from fieldlens.session import checkpoint

SIDE = ("path", "tag", "value", "attrs", "summary", "pos", "key", "parent_key")
# what the comparison reads of a flattened document
DIFF_COLUMNS = ("path", "tag", "kind", "value", "attrs", "head_tags", "n_children", "pos", "pos_path", "key_path", "key", "shadowed")


def _side(nodes: DataFrame, doc_id: str, prefix: str, ordered: bool) -> DataFrame:
    key = "pos_path" if ordered else "key_path"
    rows = nodes.filter(F.col("kind") == "element")
    if not ordered:
        rows = rows.filter(~F.col("shadowed"))
    rows = rows.withColumn("summary", node_summary()).withColumn("parent_key", F.regexp_replace(key, "/[^/]*$", ""))
    # identifying values may contain a slash, so the parent of a key path is cut by its length
    if not ordered:
        rows = rows.withColumn("parent_key", F.expr("left(key_path, length(key_path) - length(`key`) - 1)"))
    return rows.select(doc_id, F.col(key).alias("pair_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in SIDE])


def _attr_changes(path: Column) -> Column:
    a, b = F.col("a_attrs"), F.col("b_attrs")
    names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))

    def one(n):
        old, new = F.try_element_at(a, n), F.try_element_at(b, n)
        kind = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old != new, "changed")
        details = F.when(old.isNull(), "Attribute added").when(new.isNull(), "Attribute removed").otherwise("Attribute value changed")
        return F.struct(kind.alias("diff_type"), F.concat(path, F.lit("/@"), n).alias("path"), n.alias("element"),
                        old.alias("left_value"), new.alias("right_value"), details.alias("details"))

    return F.filter(F.transform(names, one), lambda r: r["diff_type"].isNotNull())


def message_diff(a: DataFrame, b: DataFrame, doc_id: str = "msg_id", ignore_order: bool = False,
                 ignore_attributes: bool = False, ignore_whitespace: bool = True) -> DataFrame:
    """Added, removed and changed nodes of messages with the same id.

    ``a`` and ``b`` come from ``flatten_xml(.., pairing=True)``. Siblings meet by position,
    or with ``ignore_order`` by their identifying child. A tag mismatch or a missing element
    is reported once and its subtree is skipped: below it the parents' paths differ.
    """
    ordered = not ignore_order
    left, right = _side(a, doc_id, "a", ordered), _side(b, doc_id, "b", ordered)
    # one join, stored once; the changes and both one-sided lists read it
    pairs = checkpoint(left.join(right, [doc_id, "pair_key"], "full"))

    both = F.col("a_path").isNotNull() & F.col("b_path").isNotNull()
    comparable = t.parent_path("a_path") == t.parent_path("b_path")
    norm = (lambda c: t.collapse_ws(c)) if ignore_whitespace else (lambda c: t.blank(c))
    old, new = norm("a_value"), norm("b_value")
    shown = lambda c: F.when(c == "", "(empty)").otherwise(c)
    same_tag = F.col("a_tag") == F.col("b_tag")
    path = F.col("a_path")

    def row(kind, p, element, lv, rv, details):
        return F.struct(F.lit(kind).alias("diff_type"), p.alias("path"), element.alias("element"),
                        lv.alias("left_value"), rv.alias("right_value"), F.lit(details).alias("details"))

    found = F.array_compact(F.array(
        F.when(~same_tag, row("changed", path, F.col("a_tag"), F.col("a_tag"), F.col("b_tag"), "Element tag changed")),
        F.when(same_tag & (old != new), row("changed", path, F.col("a_tag"), shown(old), shown(new), "Text content changed"))))
    if not ignore_attributes:
        found = F.concat(found, F.when(same_tag, _attr_changes(path)).otherwise(F.filter(_attr_changes(path), lambda r: F.lit(False))))
    changed = pairs.filter(both & comparable).select(doc_id, F.col("a_pos").alias("pos"), F.inline(found))

    def one_sided(mine: str, other: str, kind: str) -> DataFrame:
        """Elements of one side whose parent meets an equal parent on the other side."""
        alone = pairs.filter(F.col(f"{other}_path").isNull()).select(
            doc_id, F.col(f"{mine}_parent_key").alias("parent_key"), t.parent_path(f"{mine}_path").alias("parent_path"),
            *[F.col(f"{mine}_{c}").alias(c) for c in ("tag", "summary", "pos", "key")])
        parents = pairs.filter(both).select(doc_id, F.col("pair_key").alias("parent_key"), F.col(f"{other}_path").alias("parent_path"))
        last = (F.concat("tag", F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("]")) if ordered else F.col("key"))
        none = F.lit(None).cast("string")
        lv, rv = (none, F.col("summary")) if kind == "added" else (F.col("summary"), none)
        return alone.join(parents, [doc_id, "parent_key", "parent_path"], "left_semi").select(
            doc_id, "pos", F.lit(kind).alias("diff_type"), F.concat("parent_path", F.lit("/"), last).alias("path"),
            F.col("tag").alias("element"), lv.alias("left_value"), rv.alias("right_value"), F.lit(f"Element {kind}").alias("details"))

    return (changed.unionByName(one_sided("a", "b", "removed"))
            .unionByName(one_sided("b", "a", "added")))


def compare_messages(a: DataFrame, b: DataFrame, doc_id: str = "msg_id", xml: str = "xml", ignore_order: bool = False,
                     ignore_attributes: bool = False, ignore_whitespace: bool = True, keep_ns: bool = False) -> DataFrame:
    """The same differences from message tables (``doc_id``, ``xml``): one exchange a side, nothing stored.

    The two texts of a message meet by its id; equal texts leave there. The others are parsed side by side, digests of their
    subtrees leave out what did not change, and every differing place is one row, so nothing is joined or shuffled again.
    """
    side = lambda df, name: df.select(doc_id, F.col(xml).alias(name))
    pairs = side(a, "left").join(side(b, "right"), doc_id).filter(F.col("left") != F.col("right"))
    ordered = not ignore_order
    places = differing_nodes(pairs, doc_id, "left", "right", ordered, keep_ns)
    here = lambda last: F.concat("parent_path", F.when(F.col("parent_path") != "", "/").otherwise(""), last)
    norm = t.collapse_ws if ignore_whitespace else t.blank
    old, new = norm("a_value"), norm("b_value")
    shown = lambda c: F.when(c == "", "(empty)").otherwise(c)
    none = F.lit(None).cast("string")

    def row(kind, path, element, lv, rv, details):
        return F.struct(F.lit(kind).alias("diff_type"), path.alias("path"), element.alias("element"),
                        lv.alias("left_value"), rv.alias("right_value"), F.lit(details).alias("details"))

    def alone(mine: str, kind: str):
        last = F.concat(f"{mine}_tag", F.lit("["), (F.col(f"{mine}_pos") + 1).cast("string"), F.lit("]")) if ordered else F.col(f"{mine}_key")
        summary = node_summary(f"{mine}_")
        return row(kind, here(last), F.col(f"{mine}_tag"), *((none, summary) if kind == "added" else (summary, none)), f"Element {kind}")

    path, same_tag = here(F.col("a_tag")), F.col("a_tag") == F.col("b_tag")
    found = F.array_compact(F.array(
        F.when(F.col("b_tag").isNull(), alone("a", "removed")),
        F.when(F.col("a_tag").isNull(), alone("b", "added")),
        F.when(~same_tag, row("changed", path, F.col("a_tag"), F.col("a_tag"), F.col("b_tag"), "Element tag changed")),
        F.when(same_tag & (old != new), row("changed", path, F.col("a_tag"), shown(old), shown(new), "Text content changed"))))
    if not ignore_attributes:
        found = F.when(same_tag, F.concat(found, _attr_changes(path))).otherwise(found)
    return places.select(doc_id, F.coalesce("a_pos", "b_pos").alias("pos"), F.inline(found))


def message_diff_stats(diff: DataFrame, messages: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Per message: identical flag and counts, also for messages without a difference."""
    counts = diff.groupBy(doc_id).agg(*[F.count_if(F.col("diff_type") == k).alias(k) for k in ("added", "removed", "changed")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (messages.select(doc_id).join(counts, doc_id, "left").select(doc_id, zero("added"), zero("removed"), zero("changed"))
            .withColumn("identical", (F.col("added") + F.col("removed") + F.col("changed")) == 0))
