"""Field catalogs from schema documents: types, edges, facets, annotations, expanded paths.

A schema document is flattened once; owners (the type or element a node belongs to) are
found from the node's own tag path and position path, so no step walks the document again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import joins, ordered
from fieldlens.operators.flatten import flatten_xml
from fieldlens.operators.trees import expand_paths
from fieldlens.session import checkpoint

INHERITANCE = ("base_then_derived", "derived_only", "extension_only", "restriction_sequence")
ATTRIBUTE_SLOT = 1_000_000_000
NODE_COLUMNS = ("node_id", "parent_id", "pos", "depth", "path", "pos_path", "tag", "kind", "attrs", "value")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def schema_nodes(docs: DataFrame, doc_id: str = "schema_id", text: str = "text") -> DataFrame:
    """Node table of XSD texts: elements, attributes, types, compositors, facets, annotations."""
    nodes = flatten_xml(docs, doc_id, text, pairing=True, columns=NODE_COLUMNS, attributes=False).filter(F.col("kind") == "element")
    return nodes.select(doc_id, "node_id", "parent_id", "pos", "depth", "path", "pos_path", "tag", "attrs", F.coalesce("value", F.lit("")).alias("value"))


def owner(*tags: str) -> Column:
    """Position path of the nearest ancestor with one of the tags (null when there is none)."""
    parts = F.split("path", "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    wanted = F.array(*[F.lit(x) for x in tags])
    index = F.array_max(F.filter(F.transform(above, lambda x, i: F.when(F.array_contains(wanted, x), i + 1)), lambda i: i.isNotNull()))
    # a position path starts with '/', so its first part is empty
    return F.when(index.isNotNull(), F.array_join(F.slice(F.split("pos_path", "/"), 1, index + 1), "/"))


def type_table(nodes: DataFrame) -> DataFrame:
    """Types of every document, unnamed ones under a generated name: kind, base, derivation, owner position."""
    types = nodes.filter(F.col("tag").isin("complexType", "simpleType")).select(
        "schema_id", "node_id", F.col("pos_path").alias("type_key"), F.col("tag").alias("kind"),
        F.coalesce(attr("name"), F.concat(F.lit("anonymous:"), "pos_path")).alias("type_name"))
    derived = (nodes.filter(F.col("tag").isin("extension", "restriction"))
               .select("schema_id", owner("complexType", "simpleType").alias("type_key"), F.struct("node_id", F.col("tag").alias("via"), t.strip_ns(attr("base")).alias("base")).alias("d"))
               .groupBy("schema_id", "type_key").agg(F.min("d").alias("d")))
    return types.join(derived, ["schema_id", "type_key"], "left").select(
        "schema_id", "type_name", "kind", F.coalesce("d.base", F.lit("")).alias("base"), F.coalesce("d.via", F.lit("")).alias("via"), "type_key", "node_id")


def content_model(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """First compositor of each complex type; sequence when it has none."""
    first = (nodes.filter(F.col("tag").isin("sequence", "choice", "all", "group"))
             .select("schema_id", owner("complexType").alias("type_key"), "node_id", "tag")
             .groupBy("schema_id", "type_key").agg(F.min_by("tag", "node_id").alias("model")))
    return types.filter("kind = 'complexType'").join(first, ["schema_id", "type_key"], "left").select(
        "schema_id", "type_name", F.coalesce("model", F.lit("sequence")).alias("model"))


def facets(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """(schema_id, type_name, facet, value, node_id) of every facet."""
    rows = nodes.filter(F.col("tag").isin(*fixed.FACET_TAGS)).select(
        "schema_id", owner("simpleType", "complexType").alias("type_key"), F.col("tag").alias("facet"), attr("value").alias("value"), F.col("node_id"))
    return rows.join(types.select("schema_id", "type_key", "type_name"), ["schema_id", "type_key"]).drop("type_key")


def facet_columns(facet_rows: DataFrame) -> DataFrame:
    """One row per type with a column per facet; an exact length sets both bounds."""
    one = lambda name: F.max(F.when(F.col("facet") == name, F.col("value")))
    enums = F.array_sort(F.collect_list(F.when(F.col("facet") == "enumeration", F.struct("node_id", "value"))))
    wide = facet_rows.groupBy("schema_id", "type_name").agg(
        one("pattern").alias("pattern"), one("minLength").alias("lo"), one("maxLength").alias("hi"), one("length").alias("length"),
        one("minInclusive").alias("min_value"), one("maxInclusive").alias("max_value"), one("minExclusive").alias("min_exclusive"),
        one("maxExclusive").alias("max_exclusive"), one("fractionDigits").alias("fraction_digits"), one("totalDigits").alias("total_digits"),
        one("whiteSpace").alias("white_space"), enums.alias("e"))
    return wide.select(
        "schema_id", "type_name", "pattern", F.coalesce("length", "lo").alias("min_length"), F.coalesce("length", "hi").alias("max_length"), "length",
        "min_value", "max_value", "min_exclusive", "max_exclusive", "fraction_digits", "total_digits", "white_space",
        F.transform("e", lambda x: x["value"]).alias("enums"))


def restriction_text(max_enum: int = 5) -> Column:
    """One text of the facet columns: enumeration, pattern and lengths."""
    labelled = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), c))
    enums = F.when(F.size("enums") > 0, F.concat(F.lit("Enum: "), F.array_join(F.slice("enums", 1, max_enum), ", "),
                                                 F.when(F.size("enums") > max_enum, "...").otherwise("")))
    exact = F.col("length").isNotNull()
    return F.concat_ws(" | ", enums, labelled("Pattern", F.col("pattern")), labelled("minLength", F.when(~exact, F.col("min_length"))),
                       labelled("maxLength", F.when(~exact, F.col("max_length"))), labelled("length", F.col("length")))


def constraint_phrases() -> Column:
    """Readable rules of the facet columns as an array."""
    lo, hi, a, b = F.col("min_length"), F.col("max_length"), F.col("min_value"), F.col("max_value")
    lit, cat = F.lit, F.concat
    n = F.size("enums")
    return F.array_compact(F.array(
        F.when(n > 0, cat(lit("Must be one of: "), F.array_join(F.slice("enums", 1, 5), ", "), F.when(n > 5, "...").otherwise(""))),
        F.when(t.blank("pattern") != "", cat(lit("Must match pattern: "), F.col("pattern"))),
        F.when(F.col("length").isNotNull(), cat(lit("Must be exactly "), F.col("length"), lit(" characters")))
        .when(lo.isNotNull() & hi.isNotNull(), cat(lit("Length must be "), lo, lit("-"), hi, lit(" characters")))
        .when(hi.isNotNull(), cat(lit("Maximum "), hi, lit(" characters"))).when(lo.isNotNull(), cat(lit("Minimum "), lo, lit(" characters"))),
        F.when(a.isNotNull() & b.isNotNull(), cat(lit("Value must be between "), a, lit(" and "), b))
        .when(a.isNotNull(), cat(lit("Minimum value: "), a)).when(b.isNotNull(), cat(lit("Maximum value: "), b)),
        F.when(F.col("fraction_digits").isNotNull(), cat(lit("Up to "), F.col("fraction_digits"), lit(" decimal places")))))


# ---- elements ----------------------------------------------------------------------

def elements(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Element declarations with their owning type: (schema_id, edge_id, parent_type, tag, type, bounds, choice).

    Global elements have no parent type. References take name and type of the global element
    and keep their own bounds. An inline type counts as the element's type.
    """
    decl = nodes.filter(F.col("tag") == "element").select(
        "schema_id", F.col("node_id").alias("edge_id"), "pos_path", owner("complexType", "group").alias("type_key"), owner("choice").alias("choice_key"),
        attr("name").alias("name"), t.strip_ns(attr("ref")).alias("ref"), t.strip_ns(attr("type")).alias("type"),
        F.coalesce(attr("minOccurs"), F.lit("1")).alias("min_occurs"), F.coalesce(attr("maxOccurs"), F.lit("1")).alias("max_occurs"),
        t.blank(attr("default")).alias("dflt"), t.blank(attr("fixed")).alias("fixed"))
    owners = types.select("schema_id", "type_key", F.col("type_name").alias("parent_type"))
    inline = types.filter(F.col("type_name").startswith("anonymous:")).select(
        "schema_id", F.regexp_replace("type_key", "/[^/]*$", "").alias("pos_path"), F.col("type_name").alias("inline_type"))
    placed = decl.join(owners, ["schema_id", "type_key"], "left").join(inline, ["schema_id", "pos_path"], "left").withColumn(
        "type", F.coalesce("inline_type", "type"))
    targets = placed.filter(F.col("parent_type").isNull() & F.col("name").isNotNull()).select(
        "schema_id", F.col("name").alias("ref"), F.col("type").alias("ref_type"), F.col("edge_id").alias("target_id"))
    resolved = placed.join(targets, ["schema_id", "ref"], "left")
    in_choice = F.col("choice_key").isNotNull() & (F.length("choice_key") > F.length(F.coalesce("type_key", F.lit(""))))
    return resolved.select(
        "schema_id", "edge_id", "parent_type", F.coalesce("name", F.nullif("ref", F.lit(""))).alias("tag"), F.coalesce("ref_type", "type").alias("type"),
        "min_occurs", "max_occurs", "dflt", "fixed", in_choice.alias("in_choice"), F.when(in_choice, F.col("choice_key")).alias("choice_key"), "target_id")


def inheritance_chain(types: DataFrame) -> DataFrame:
    """Each type with every type of its derivation chain: (schema_id, type_name, base, level, via)."""
    steps = types.filter(F.col("base") != "").select("schema_id", F.col("type_name").alias("parent"), F.col("base").alias("child"), F.lit(0).alias("pos"))
    starts = types.select("schema_id", F.col("type_name").alias("node"), F.lit(0).alias("pos"))
    walked = expand_paths(steps, starts, by=("schema_id",), sep=" → ")
    return walked.select("schema_id", F.split_part("path", F.lit(" → "), F.lit(1)).alias("type_name"), F.col("node").alias("base"), F.col("depth").alias("level"), F.col("path").alias("chain"))


def chain_text(types: DataFrame) -> DataFrame:
    """Longest derivation chain of each type as text."""
    return inheritance_chain(types).groupBy("schema_id", "type_name").agg(F.max_by("chain", "level").alias("chain"), F.max("level").alias("steps"))


def content_edges(elems: DataFrame, types: DataFrame, mode: str = "derived_only") -> DataFrame:
    """Edges type -> element under an inheritance mode.

    derived_only: the type's own content. base_then_derived: content of its bases first, a
    repeated name taken from the most derived type. extension_only: like base_then_derived
    but restrictions contribute nothing of their own. restriction_sequence: own content of
    restrictions without choices, otherwise own content.
    """
    if mode not in INHERITANCE:
        raise ValueError(f"unknown inheritance mode {mode}; one of {INHERITANCE}")
    own = elems.filter(F.col("parent_type").isNotNull()).withColumn("level", F.lit(0))
    via = types.select("schema_id", F.col("type_name").alias("parent_type"), "via")
    if mode == "restriction_sequence":
        kept = own.join(via, ["schema_id", "parent_type"], "left")
        return kept.filter((F.coalesce("via", F.lit("")) != "restriction") | ~F.col("in_choice")).drop("via")
    if mode == "derived_only":
        return own
    if mode == "extension_only":
        own = own.join(via, ["schema_id", "parent_type"], "left").filter(F.coalesce("via", F.lit("")) != "restriction").drop("via")
    bases = inheritance_chain(types).filter("level > 0").select("schema_id", F.col("type_name").alias("derived"), F.col("base").alias("parent_type"), F.col("level").alias("up"))
    inherited = own.join(bases, ["schema_id", "parent_type"]).withColumn("parent_type", F.col("derived")).withColumn("level", F.col("up")).drop("derived", "up")
    both = own.unionByName(inherited)
    # one type's content is one element list, so this window stays within a declaration
    newest = W.partitionBy("schema_id", "parent_type", "tag").orderBy("level")
    return both.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn")


def expand_catalog(nodes: DataFrame, mode: str = "derived_only", max_depth: int | None = None, on_repeat: str = "skip") -> DataFrame:
    """Field catalog of schema documents: every element path from the global elements, with bounds and sequence."""
    # declarations are read by every level and again for the columns: stored once
    types = type_table(nodes)
    elems = checkpoint(elements(nodes, types))
    content = content_edges(elems, types, mode)
    # bases come before derived content: the higher the level, the earlier the slot
    slot = F.lit(ATTRIBUTE_SLOT) + F.col("edge_id") - F.col("level") * 10_000_000
    edges = content.select("schema_id", F.col("parent_type").alias("parent"), F.col("type").alias("child"), F.col("tag").alias("label"), slot.alias("pos"), "edge_id")
    # a global element that others refer to is no document root
    referred = elems.filter(F.col("target_id").isNotNull()).select("schema_id", F.col("target_id").alias("edge_id"))
    roots = elems.filter(F.col("parent_type").isNull()).join(referred, ["schema_id", "edge_id"], "left_anti").select(
        "schema_id", F.col("type").alias("node"), F.col("tag").alias("label"), F.col("edge_id").alias("pos"), "edge_id")
    paths = expand_paths(edges, roots, max_depth, on_repeat, by=("schema_id",))
    info = elems.select("schema_id", "edge_id", "tag", "type", "min_occurs", "max_occurs", "dflt", "fixed", "in_choice", "choice_key")
    return number(paths.join(info, ["schema_id", "edge_id"]).withColumn("node_type", F.lit("element")))


def number(rows: DataFrame) -> DataFrame:
    """Document-order number from the array of positions along the path, per schema."""
    return ordered.number_sorted(rows, ["schema_id"], ["sort_key", "path"], "seq").withColumn("seq", F.col("seq").cast("int"))


def attribute_rows(catalog: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Attributes of the catalog's elements as rows: ``@name``, min 1 when required, max 1."""
    decl = nodes.filter(F.col("tag") == "attribute").select(
        "schema_id", owner("complexType").alias("type_key"), F.col("node_id").alias("attr_id"), F.concat(F.lit("@"), attr("name")).alias("attr_tag"),
        t.strip_ns(attr("type")).alias("attr_type"), F.when(attr("use") == "required", "1").otherwise("0").alias("attr_min"))
    named = decl.join(types.select("schema_id", "type_key", F.col("type_name").alias("type")), ["schema_id", "type_key"])
    return catalog.join(named, ["schema_id", "type"]).select(
        "schema_id", F.concat("path", F.lit("/"), "attr_tag").alias("path"), F.col("attr_tag").alias("tag"), F.col("attr_type").alias("type"),
        F.col("attr_min").alias("min_occurs"), F.lit("1").alias("max_occurs"), (F.col("depth") + 1).alias("depth"), F.lit("attribute").alias("node_type"),
        F.concat("sort_key", F.array(F.lit(ATTRIBUTE_SLOT) + F.col("attr_id"))).alias("sort_key"))


def choice_columns(catalog: DataFrame) -> DataFrame:
    """'[CHOICE i of n]' for the options of a choice under the same parent."""
    group = W.partitionBy("schema_id", t.parent_path("path"), "choice_key")
    i, n = F.row_number().over(group.orderBy("seq")), F.count("*").over(group)
    return catalog.withColumn("choice", F.when(F.col("in_choice"), F.format_string("[CHOICE %d of %d]", i, n)).otherwise(""))


# ---- annotations -------------------------------------------------------------------

def annotations(nodes: DataFrame) -> DataFrame:
    """(schema_id, edge_id, pos, source, text) of element annotations."""
    docs = nodes.filter((F.col("tag") == "documentation") & F.col("path").endswith("element/annotation/documentation")).select(
        "schema_id", owner("element").alias("pos_path"), F.col("node_id").alias("pos"), F.trim(t.blank(attr("source"))).alias("source"), F.trim("value").alias("text"))
    elems = nodes.filter(F.col("tag") == "element").select("schema_id", "pos_path", F.col("node_id").alias("edge_id"))
    return docs.join(elems, ["schema_id", "pos_path"]).drop("pos_path")


def annotation_buckets(rows: DataFrame, keys: Sequence[str] = ("schema_id", "edge_id")) -> DataFrame:
    """Documentation, rulebook and usage rules by source, joined in document order."""
    src, text = F.col("source"), F.col("text")
    kept = rows.filter((text != "") & ~src.isin("Yellow Field", "White Field"))
    doc, rule = src.isin("Name", "Definition", ""), src == "Rulebook"
    joined = lambda cond, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", value.alias("v"))))), lambda x: x["v"]), " | ")
    usage = F.when(src == "Usage Rule", text).otherwise(F.concat(src, F.lit(": "), text))
    return kept.groupBy(*keys).agg(
        joined(doc, text).alias("documentation"), F.coalesce(F.max_by(F.when(rule, text), F.when(rule, F.col("pos"))), F.lit("")).alias("rulebook"),
        joined(~doc & ~rule, usage).alias("usage_rules"))


def field_class(rows: DataFrame, keys: Sequence[str] = ("schema_id", "edge_id")) -> DataFrame:
    """First Yellow or White annotation in document order (elements without one are absent: NA)."""
    cls = F.when(F.col("source") == "Yellow Field", "YELLOW").when(F.col("source") == "White Field", "WHITE").when(F.col("source") == "Red Field", "RED")
    return rows.withColumn("c", cls).filter(F.col("c").isNotNull()).groupBy(*keys).agg(F.min_by("c", "pos").alias("field_class"))


def full_catalog(nodes: DataFrame, mode: str = "derived_only") -> DataFrame:
    """Expanded catalog with facets, restriction text, class and annotation columns.

    Facets come from the element's (inline or named) type; a derived simple type without
    facets of its own takes those of its base.
    """
    types = type_table(nodes)
    cat = expand_catalog(nodes, mode)
    cols = facet_source(nodes, types)
    notes = annotations(nodes)
    keys = ["schema_id", "edge_id"]
    rows = cat.join(cols.withColumnRenamed("type_name", "type"), ["schema_id", "type"], "left")
    rows = rows.join(annotation_buckets(notes), keys, "left").join(field_class(notes), keys, "left")
    rows = rows.withColumn("enums", F.coalesce("enums", F.array().cast("array<string>")))
    return rows.withColumn("restrictions", restriction_text()).withColumn("field_class", F.coalesce("field_class", F.lit("NA"))).fillna(
        "", ["documentation", "rulebook", "usage_rules"])


def facet_source(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Facet columns per type: its own, else those of the nearest base that has any (simple content included)."""
    own = facet_columns(facets(nodes, types))
    chain = inheritance_chain(types).select("schema_id", "type_name", F.col("base").alias("source_type"), "level")
    found = chain.join(own.withColumnRenamed("type_name", "source_type"), ["schema_id", "source_type"])
    rest = [c for c in found.columns if c not in ("schema_id", "type_name", "level")]
    return found.groupBy("schema_id", "type_name").agg(F.min_by(F.struct(*rest), "level").alias("r")).select("schema_id", "type_name", "r.*").drop("source_type")


# ---- naming ------------------------------------------------------------------------

def schema_metadata(nodes: DataFrame) -> DataFrame:
    """Message type and its parts from the namespace; root element, root type and scheme."""
    root = nodes.filter(F.col("depth") == 0).select("schema_id", t.blank(attr("targetNamespace")).alias("namespace"))
    first = (nodes.filter((F.col("depth") == 1) & (F.col("tag") == "element"))
             .groupBy("schema_id").agg(F.min_by(F.struct(t.blank(attr("name")).alias("root_element"), t.blank(attr("type")).alias("root_type")), "node_id").alias("r")))
    msg = F.split_part("namespace", F.lit(":xsd:"), F.lit(2))
    part = lambda i: F.split_part(msg, F.lit("."), F.lit(i))
    scheme = F.when(F.col("r.root_type").rlike("NPC|SEPA"), F.regexp_extract("r.root_type", "_(.*)$", 1)).otherwise("")
    return root.join(first, "schema_id", "left").select(
        "schema_id", msg.alias("message_type"), part(1).alias("business_area"), part(2).alias("functionality"), part(3).alias("variant"),
        part(4).alias("version"), "r.root_element", "r.root_type", scheme.alias("scheme"))


def detect_suffix(nodes: DataFrame) -> DataFrame:
    """Scheme suffix per document: what follows 'Document' in the root type, else the most frequent type suffix."""
    types = nodes.filter((F.col("tag") == "complexType") & attr("name").isNotNull())
    counted = (types.select("schema_id", F.regexp_extract(attr("name"), r"(_(?:NPC|EPC|SEPA)[\w.-]+?)(_\d+)?$", 1).alias("s"))
               .filter("s <> ''").groupBy("schema_id", "s").agg(F.count("*").alias("n"))
               .groupBy("schema_id").agg(F.min_by("s", F.struct(-F.col("n"), "s")).alias("common")))
    root = schema_metadata(nodes).select("schema_id", F.when(F.col("root_type").startswith("Document"), F.substr("root_type", F.lit(9))).alias("own"))
    return root.join(counted, "schema_id", "left").select("schema_id", F.coalesce(F.nullif("own", F.lit("")), "common", F.lit("")).alias("suffix"))


def base_type(type_name, suffix) -> Column:
    """Type name without the suffix and a trailing ``_N``."""
    plain = F.replace(t._c(type_name), t._c(suffix))
    return F.when(t.blank(suffix) == "", t._c(type_name)).otherwise(F.regexp_replace(plain, r"_\d+$", ""))


def resolve_variant(refs: DataFrame, types: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Scheme-specific variant of referenced types: itself when suffixed, type+suffix when defined, else the type."""
    wanted = joins.dim_join(refs, suffixes, ["schema_id"], "inner").withColumn("variant", F.concat("type", "suffix"))
    defined = types.filter("kind = 'complexType'").select("schema_id", F.col("type_name").alias("variant"), F.lit(True).alias("has")).distinct()
    has_suffix = (F.col("suffix") != "") & F.col("type").contains(F.col("suffix"))
    return wanted.join(defined, ["schema_id", "variant"], "left").withColumn(
        "resolved", F.when(has_suffix, F.col("type")).when(F.col("has"), F.col("variant")).otherwise(F.col("type"))).drop("has")


def type_edges(catalog: DataFrame, types: DataFrame) -> DataFrame:
    """(schema_id, from_path, to_type, label) for elements of a named type."""
    named = types.filter(~F.col("type_name").startswith("anonymous:")).select("schema_id", F.col("type_name").alias("type"))
    return catalog.join(named, ["schema_id", "type"], "left_semi").select(
        "schema_id", F.col("path").alias("from_path"), F.col("type").alias("to_type"), F.col("tag").alias("label"))


def props_map(nodes: DataFrame) -> DataFrame:
    """XSD attributes of a declaration as a map without its name, prefixes stripped."""
    kept = F.map_filter("attrs", lambda k, v: k != "name")
    return nodes.select("schema_id", "node_id", "tag", F.transform_values(kept, lambda k, v: t.strip_ns(v)).alias("props"))
