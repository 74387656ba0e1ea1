"""Schema documents: one XSD per brand, rendered from the parts, read back as catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.operators import xsd
from fieldlens.registry import Group
from fieldlens.session import checkpoint

GROUP = Group()

_SIMPLE = """<xs:simpleType name="P0"><xs:restriction base="xs:string"><xs:minLength value="1"/><xs:maxLength value="35"/></xs:restriction></xs:simpleType>
<xs:simpleType name="P1"><xs:restriction base="xs:decimal"><xs:minInclusive value="0"/><xs:fractionDigits value="2"/><xs:totalDigits value="18"/></xs:restriction></xs:simpleType>
<xs:simpleType name="P2"><xs:restriction base="xs:string"><xs:enumeration value="CODC"/><xs:enumeration value="CODA"/><xs:enumeration value="CODB"/><xs:enumeration value="CODD"/><xs:enumeration value="CODE"/><xs:enumeration value="CODF"/></xs:restriction></xs:simpleType>
<xs:simpleType name="P3"><xs:restriction base="P0"><xs:pattern value="[A-Z]{3,3}"/></xs:restriction></xs:simpleType>
<xs:complexType name="Money"><xs:simpleContent><xs:extension base="P1"><xs:attribute name="Ccy" type="P2" use="required"/><xs:attribute name="Note" type="P0"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:complexType name="Base"><xs:sequence><xs:element name="BaseId"><xs:simpleType><xs:restriction base="xs:string"><xs:length value="10"/></xs:restriction></xs:simpleType></xs:element></xs:sequence></xs:complexType>
<xs:element name="Remark" type="P0"/>"""


def schema_docs(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("schema_id"), F.col("p_type").alias("t"), F.col("p_size").alias("s"))
    note = lambda when, source, text: F.expr(f"case when {when} then concat('<xs:documentation source=\"{source}\">', {text}, '</xs:documentation>') else '' end")
    docs = F.concat(note("k % 3 = 0", "Yellow Field", "''"), note("k % 3 = 1", "White Field", "''"), note("k % 4 = 0", "Rulebook", "concat('AT-', k % 40)"),
                    note("k % 5 = 0", "Usage Rule", "concat('rule ', k)"), note("k % 6 = 0", "Definition", "concat('def ', k)"), note("k % 7 = 0", "Other", "concat('o', k)"))
    element = F.concat(
        F.expr("concat('<xs:element name=\"F', k, '\" type=\"', case when s % 5 = 0 then 'Money' else concat('P', s % 4) end, '\" minOccurs=\"', k % 2, '\"')"),
        F.expr("case when k % 7 = 0 then ' maxOccurs=\"unbounded\"' else '' end"), F.expr("case when k % 11 = 0 then ' fixed=\"X\"' else '' end"),
        F.lit("><xs:annotation>"), docs, F.lit("</xs:annotation></xs:element>"))
    lists = part.select("schema_id", "t", "k", element.alias("e")).groupBy("schema_id", "t").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]), "\n").alias("body"))
    name = F.concat("t", F.lit("_NPC_"), "schema_id")
    wrapped = F.when(F.col("t") == "SMALL", F.concat(F.lit("<xs:choice>"), "body", F.lit("</xs:choice>"))).otherwise(F.concat(F.lit("<xs:sequence>"), "body", F.lit("</xs:sequence>")))
    wrapped = F.when(F.col("t") == "ECONOMY", F.concat(F.lit('<xs:complexContent><xs:extension base="Base">'), wrapped, F.lit("</xs:extension></xs:complexContent>"))).otherwise(wrapped)
    types = lists.select("schema_id", "t", F.concat(F.lit('<xs:complexType name="'), name, F.lit('">'), wrapped, F.lit("</xs:complexType>")).alias("ct"),
                         F.concat(F.lit('<xs:element name="'), "t", F.lit('" type="'), name, F.lit('"/>')).alias("ref"))
    per = types.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("t", "ct", "ref"))).alias("l"))
    text = F.concat(
        F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:iso:std:iso:20022:tech:xsd:pacs.008.001.08">'),
        F.lit('<xs:element name="Document" type="Document_NPC_'), "schema_id", F.lit('"/><xs:complexType name="Document_NPC_'), "schema_id",
        F.lit('"><xs:sequence>'), F.array_join(F.transform("l", lambda x: x["ref"]), ""), F.lit('<xs:element ref="Remark" minOccurs="0" maxOccurs="3"/></xs:sequence></xs:complexType>'),
        F.array_join(F.transform("l", lambda x: x["ct"]), "\n"), F.lit(_SIMPLE), F.lit("</xs:schema>"))
    return per.select("schema_id", text.alias("text"))


def _nodes(spark, sf_dir):
    # read many times by the operators: parsed and stored once
    return checkpoint(xsd.schema_nodes(schema_docs(spark, sf_dir)), sized=False)


# Expected catalog rows: document order is Document, each type with its parts by key, then Remark.
EXPECTED = """p as (select replace(p_brand, '#', '_') as schema_id, p_type as t, p_partkey as k, p_size as s from part),
cat as (
select distinct schema_id, 'Document' as path, '' as o1, -2 as o2, concat('Document_NPC_', schema_id) as type, '1' as min_occurs, '1' as max_occurs, '' as fixed, false as in_choice from p
union all select distinct schema_id, concat('Document/', t), t, -2, concat(t, '_NPC_', schema_id), '1', '1', '', false from p
union all select schema_id, concat('Document/', t, '/F', k), t, k, case when s % 5 = 0 then 'Money' else concat('P', s % 4) end, cast(k % 2 as varchar), case when k % 7 = 0 then 'unbounded' else '1' end, case when k % 11 = 0 then 'X' else '' end, t = 'SMALL' from p
union all select distinct schema_id, 'Document/Remark', '~', -2, 'P0', '0', '3', '', false from p),
withbase as (select * from cat union all select distinct schema_id, 'Document/ECONOMY/BaseId', 'ECONOMY', -1, 'inline', '1', '1', '', false from p where t = 'ECONOMY')"""


def _e(body: str, *more: str) -> str:
    return "with " + ",\n".join((EXPECTED, *more)) + f"\n{body}"


@GROUP.add("expand_catalog", _e("select schema_id, path, type, min_occurs, max_occurs, fixed, in_choice, row_number() over (partition by schema_id order by o1, o2) as seq, len(string_split(path, '/')) - 1 as depth from cat"))
def expand_catalog(spark, sf_dir):
    return xsd.expand_catalog(_nodes(spark, sf_dir)).select("schema_id", "path", "type", "min_occurs", "max_occurs", "fixed", "in_choice", "seq", "depth")


@GROUP.add("expand_with_bases", _e("select schema_id, path, row_number() over (partition by schema_id order by o1, o2) as seq from withbase"))
def expand_with_bases(spark, sf_dir):
    return xsd.expand_catalog(_nodes(spark, sf_dir), mode="base_then_derived").select("schema_id", "path", "seq")


@GROUP.add("inheritance_modes", _e("select 'derived_only' as mode, count(*) as n from cat union all select 'base_then_derived', count(*) from withbase union all select 'extension_only', count(*) from withbase union all select 'restriction_sequence', count(*) from cat"))
def inheritance_modes(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    one = lambda m: xsd.expand_catalog(nodes, m).agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n")
    a, b, c, d = (one(m) for m in xsd.INHERITANCE)
    return a.unionByName(b).unionByName(c).unionByName(d)


TYPES = """ty as (select distinct schema_id, concat('Document_NPC_', schema_id) as type_name, 'complexType' as kind, '' as base, '' as via, 'sequence' as model from p
union all select distinct schema_id, concat(t, '_NPC_', schema_id), 'complexType', case when t = 'ECONOMY' then 'Base' else '' end, case when t = 'ECONOMY' then 'extension' else '' end, case when t = 'SMALL' then 'choice' else 'sequence' end from p
union all select schema_id, n, k, b, v, 'sequence' from (select distinct schema_id from p) cross join (values ('P0', 'simpleType', 'string', 'restriction'), ('P1', 'simpleType', 'decimal', 'restriction'), ('P2', 'simpleType', 'string', 'restriction'),
  ('P3', 'simpleType', 'P0', 'restriction'), ('Money', 'complexType', 'P1', 'extension'), ('Base', 'complexType', '', '')) x(n, k, b, v))"""


@GROUP.add("type_table", _e("select schema_id, type_name, kind, base, via from ty", TYPES))
def type_table(spark, sf_dir):
    return xsd.type_table(_nodes(spark, sf_dir)).filter("type_name not like 'anonymous:%'").select("schema_id", "type_name", "kind", "base", "via")


@GROUP.add("content_model", _e("select schema_id, type_name, model from ty where kind = 'complexType'", TYPES))
def content_model(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return xsd.content_model(nodes, xsd.type_table(nodes))


@GROUP.add("inheritance_chain", _e("""
select schema_id, type_name, concat(type_name, case when base <> '' then concat(' → ', base) else '' end, case base when 'P0' then ' → string' when 'P1' then ' → decimal' else '' end) as chain,
  case when base = '' then 0 when base in ('P0', 'P1') then 2 else 1 end as steps from ty""", TYPES))
def inheritance_chain(spark, sf_dir):
    return xsd.chain_text(xsd.type_table(_nodes(spark, sf_dir))).filter("type_name not like 'anonymous:%'")


FACETS = """fc as (select schema_id, n as type_name, pattern, lo as min_length, hi as max_length, fd as fraction_digits, td as total_digits, mv as min_value, en as enums, res as restrictions, ph as phrases from (select distinct schema_id from p) cross join (values
 ('P0', null, '1', '35', null, null, null, '', 'minLength: 1 | maxLength: 35', 'Length must be 1-35 characters'), ('P1', null, null, null, '2', '18', '0', '', '', 'Minimum value: 0; Up to 2 decimal places'),
 ('P2', null, null, null, null, null, null, 'CODC,CODA,CODB,CODD,CODE,CODF', 'Enum: CODC, CODA, CODB, CODD, CODE...', 'Must be one of: CODC, CODA, CODB, CODD, CODE...'), ('P3', '[A-Z]{3,3}', null, null, null, null, null, '', 'Pattern: [A-Z]{3,3}', 'Must match pattern: [A-Z]{3,3}')
 ) x(n, pattern, lo, hi, fd, td, mv, en, res, ph))"""


@GROUP.add("facet_columns", _e("select * from fc", FACETS))
def facet_columns(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    cols = xsd.facet_columns(xsd.facets(nodes, xsd.type_table(nodes))).filter("type_name not like 'anonymous:%'")
    return cols.select("schema_id", "type_name", "pattern", "min_length", "max_length", "fraction_digits", "total_digits", "min_value", F.array_join("enums", ",").alias("enums"),
                       xsd.restriction_text().alias("restrictions"), F.array_join(xsd.constraint_phrases(), "; ").alias("phrases"))


@GROUP.add("facet_source", _e("""
select schema_id, path, case src when 'P1' then '2' end as fraction_digits, case when src = 'P0' then '35' end as max_length, case when src = 'P3' then '[A-Z]{3,3}' end as pattern
from (select schema_id, path, case when type = 'Money' then 'P1' else type end as src from cat where type in ('Money', 'P0', 'P1', 'P2', 'P3'))"""))
def facet_source(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    cols = xsd.facet_source(nodes, xsd.type_table(nodes)).withColumnRenamed("type_name", "type")
    return xsd.expand_catalog(nodes).join(cols, ["schema_id", "type"]).select("schema_id", "path", "fraction_digits", "max_length", "pattern")


@GROUP.add("attribute_rows", _e("select schema_id, concat(path, a) as path, b as min_occurs, c as type from cat cross join (values ('/@Ccy', '1', 'P2'), ('/@Note', '0', 'P0')) x(a, b, c) where type = 'Money'"))
def attribute_rows(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return xsd.attribute_rows(xsd.expand_catalog(nodes), nodes, xsd.type_table(nodes)).select("schema_id", "path", "min_occurs", "type")


@GROUP.add("choice_columns", _e("select schema_id, path, case when in_choice then concat('[CHOICE ', row_number() over (partition by schema_id, in_choice order by o2), ' of ', count(*) over (partition by schema_id, in_choice), ']') else '' end as choice from cat"))
def choice_columns(spark, sf_dir):
    return xsd.choice_columns(xsd.expand_catalog(_nodes(spark, sf_dir))).select("schema_id", "path", "choice")


@GROUP.add("annotation_buckets", _e("""
select schema_id, concat('Document/', t, '/F', k) as path, case when k % 6 = 0 then concat('def ', k) else '' end as documentation, case when k % 4 = 0 then concat('AT-', k % 40) else '' end as rulebook,
  concat(case when k % 5 = 0 then concat('rule ', k) else '' end, case when k % 35 = 0 then ' | ' else '' end, case when k % 7 = 0 then concat('Other: o', k) else '' end) as usage_rules,
  case k % 3 when 0 then 'YELLOW' when 1 then 'WHITE' else 'NA' end as field_class from p"""))
def annotation_buckets(spark, sf_dir):
    rows = xsd.full_catalog(_nodes(spark, sf_dir))
    return rows.filter(F.col("tag").rlike("^F[0-9]")).select("schema_id", "path", "documentation", "rulebook", "usage_rules", "field_class")


@GROUP.add("schema_metadata", _e("select distinct schema_id, 'pacs.008.001.08' as message_type, 'pacs' as business_area, '008' as functionality, '001' as variant, '08' as version, 'Document' as root_element, concat('Document_NPC_', schema_id) as root_type, concat('NPC_', schema_id) as scheme from p"))
def schema_metadata(spark, sf_dir):
    return xsd.schema_metadata(_nodes(spark, sf_dir))


@GROUP.add("type_variants", _e("""
select distinct schema_id, t as type, concat('_NPC_', schema_id) as suffix, concat(t, '_NPC_', schema_id) as resolved, t as base from p
union all select distinct schema_id, 'P0', concat('_NPC_', schema_id), 'P0', 'P0' from p"""))
def type_variants(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    types, suffixes = xsd.type_table(nodes), xsd.detect_suffix(nodes)
    refs = xsd.elements(nodes, types).filter(F.col("parent_type").startswith("Document"))
    plain = refs.select("schema_id", F.when(F.col("tag") == "Remark", F.col("type")).otherwise(F.col("tag")).alias("type"))
    found = xsd.resolve_variant(plain, types, suffixes)
    return found.select("schema_id", "type", "suffix", "resolved", xsd.base_type("resolved", "suffix").alias("base"))


@GROUP.add("type_edges", _e("select schema_id, path as from_path, type as to_type, list_extract(string_split(path, '/'), -1) as label from cat"))
def type_edges(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return xsd.type_edges(xsd.expand_catalog(nodes), xsd.type_table(nodes))


@GROUP.add("props_map", _e("select schema_id, concat('F', k) as name, case when s % 5 = 0 then 'Money' else concat('P', s % 4) end as type, cast(k % 2 as varchar) as min_occurs from p"))
def props_map(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).filter((F.col("tag") == "element") & xsd.attr("minOccurs").isNotNull() & xsd.attr("name").isNotNull())
    names = nodes.select("schema_id", "node_id", xsd.attr("name").alias("name"))
    prop = lambda n: F.try_element_at("props", F.lit(n))
    return xsd.props_map(nodes).join(names, ["schema_id", "node_id"]).select("schema_id", "name", prop("type").alias("type"), prop("minOccurs").alias("min_occurs"))
