"""Messages: flatten, validate, compare, migrate."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldlens import fixed, fixtures as fx
from fieldlens.operators import flatten as fl, validate as vd
from fieldlens.registry import Group
from fieldlens.session import checkpoint

GROUP = Group()


def messages(spark, sf_dir, name="msg_leaf", damaged=True):
    """Leaf rows rendered as XML; every 97th document loses its last closing tag."""
    xml = fl.rebuild_xml(fx.frame(spark, sf_dir, name))
    if not damaged:
        return xml
    return xml.withColumn("xml", F.when(F.col("msg_id") % 97 == 0, F.regexp_replace("xml", "</Document>$", "")).otherwise(F.col("xml")))


def nodes(spark, sf_dir, **kw):
    return fl.flatten_xml(messages(spark, sf_dir, **kw))


OK = "ok as (select * from msg_leaf where msg_id % 97 <> 0)"


def _o(body: str, ctes: str = "") -> str:
    return fx.oracle("msg_leaf", f"with {OK}{ctes}\n{body}")


@GROUP.add("flatten_xml", fx.oracle("msg_leaf", """
with ok as (select * from msg_leaf where msg_id % 97 <> 0),
parts as (select msg_id, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as path, path as leaf, ord from ok)
select msg_id, path, case when contains(path, '@') then 'attribute' else 'element' end as kind,
  greatest(count(*) filter (path = leaf), 1) as occurrences, len(string_split(path, '/')) - 1 as depth from parts group by msg_id, path"""))
def flatten_xml(spark, sf_dir):
    good, _ = fl.parse_guard(nodes(spark, sf_dir))
    return good.groupBy("msg_id", "path", "kind", "depth").agg(F.count("*").alias("occurrences"))


@GROUP.add("flatten_roundtrip", _o("select msg_id, path, value from ok"))
def flatten_roundtrip(spark, sf_dir):
    return fl.leaves(nodes(spark, sf_dir)).select("msg_id", "path", "value")


@GROUP.add("flatten_known_shape", fx.oracle("msg_leaf", """
select msg_id, max(case when ord = 5 then value end) as amount, max(case when ord = 6 then value end) as currency, max(case when ord = 7 then value end) as bic, max(case when ord = 9 then value end) as debtor
from msg_leaf where msg_id % 97 <> 0 group by msg_id"""))
def flatten_known_shape(spark, sf_dir):
    from fieldlens.sources import messages as src

    shape = ("CdtTrfTxInf struct<IntrBkSttlmAmt: struct<_VALUE: string, _Ccy: string>, DbtrAgt: struct<FinInstnId: struct<BICFI: string>>, "
             "Dbtr: struct<Nm: string>>")
    parsed = src.parse_known_shape(messages(spark, sf_dir), shape, row_tag="Document")
    tx = "doc.CdtTrfTxInf."
    return parsed.filter("well_formed").select(
        "msg_id", F.col(tx + "IntrBkSttlmAmt._VALUE").alias("amount"), F.col(tx + "IntrBkSttlmAmt._Ccy").alias("currency"),
        F.col(tx + "DbtrAgt.FinInstnId.BICFI").alias("bic"), F.col(tx + "Dbtr.Nm").alias("debtor"))


@GROUP.add("leaf_map", _o("select msg_id, path, arg_max(value, ord) as value from ok group by 1, 2"))
def leaf_map(spark, sf_dir):
    return fl.leaf_map(fl.flatten_xml(messages(spark, sf_dir), columns=fl.LEAF_COLUMNS))


@GROUP.add("leaf_map_regrouped", _o("select msg_id, path, arg_max(value, ord) as value from ok group by 1, 2"))
def leaf_map_regrouped(spark, sf_dir):
    """The same from a node table without the last-value flag."""
    return fl.leaf_map(nodes(spark, sf_dir))


@GROUP.add("parent_of", _o("""
select msg_id, path, case when contains(path, '/') then list_extract(string_split(path, '/'), -2) end as parent_tag from ok"""))
def parent_of(spark, sf_dir):
    good, _ = fl.parse_guard(nodes(spark, sf_dir))
    return fl.parent_of(good).filter(F.col("value").isNotNull()).select("msg_id", "path", "parent_tag")


@GROUP.add("node_summary", fx.oracle("msg_leaf", """
with ok as (select * from msg_leaf where msg_id % 97 <> 0)
select msg_id, 'MsgId' as tag, concat('<MsgId>', value, '</MsgId>') as summary from ok where path like '%/MsgId'
union all select msg_id, 'GrpHdr', concat('<GrpHdr>[', array_to_string(list(list_extract(string_split(path, '/'), -1) order by ord)[1:3], ', '), case when count(*) > 3 then '...' else '' end, ']</GrpHdr>') from ok where path like '%/GrpHdr/%' group by msg_id"""))
def node_summary(spark, sf_dir):
    good, _ = fl.parse_guard(nodes(spark, sf_dir))
    return good.filter(F.col("tag").isin("MsgId", "GrpHdr")).select("msg_id", "tag", fl.node_summary().alias("summary"))


@GROUP.add("parse_guard", fx.oracle("msg_leaf", """
select distinct msg_id, 'ERROR' as severity, 'XML Parsing' as category, 'Document' as element from msg_leaf where msg_id % 97 = 0"""))
def parse_guard(spark, sf_dir):
    _, issues = fl.parse_guard(nodes(spark, sf_dir))
    return issues.select("msg_id", "severity", "category", "element")


@GROUP.add("rebuild_xml", fx.oracle("msg_leaf", """
select msg_id, concat('<Document><GrpHdr>', g, '</GrpHdr><CdtTrfTxInf><IntrBkSttlmAmt', case when ccy is null then '' else concat(' Ccy="', ccy, '"') end, '>', amt, '</IntrBkSttlmAmt><DbtrAgt><FinInstnId><BICFI>', bic, '</BICFI>',
  case when lei is null then '' else concat('<LEI>', lei, '</LEI>') end, '</FinInstnId></DbtrAgt>', case when nm is null then '' else concat('<Dbtr><Nm>', nm, '</Nm></Dbtr>') end, '<DbtrAcct><Id><IBAN>', iban, '</IBAN></Id></DbtrAcct><RmtInf><Ustrd>', u, '</Ustrd>',
  case when r is null then '' else concat('<Strd><Ref>', r, '</Ref></Strd>') end, '</RmtInf></CdtTrfTxInf></Document>') as xml
from (select msg_id, string_agg(concat('<', t, '>', value, '</', t, '>'), '' order by ord) filter (ord <= 4) as g, max(value) filter (ord = 5) as amt, max(value) filter (ord = 6) as ccy, max(value) filter (ord = 7) as bic,
  max(value) filter (ord = 8) as lei, max(value) filter (ord = 9) as nm, max(value) filter (ord = 10) as iban, max(value) filter (ord = 11) as u, max(value) filter (ord = 12) as r
  from (select *, list_extract(string_split(path, '/'), -1) as t from msg_leaf) group by msg_id)"""))
def rebuild_xml(spark, sf_dir):
    return messages(spark, sf_dir, damaged=False)


# ---- validation --------------------------------------------------------------------

def _rule_query(rules, *columns):
    def run(spark, sf_dir):
        good, _ = fl.parse_guard(nodes(spark, sf_dir))
        return vd.apply_rules(good, rules()).select("msg_id", *columns)

    return run


EITHER = """select r.msg_id, 'ERROR' as severity, 'Business Rule' as category, concat('Document/CdtTrfTxInf/', case when k = 'F' then 'DbtrAgt/FinInstnId' else 'RmtInf' end) as path,
  case when k = 'F' then 'FinInstnId' else 'RmtInf' end as element, concat('Multiple mutually exclusive elements found: ', case when k = 'F' then 'BICFI, LEI' else 'Ustrd, Strd' end) as message,
  cast(null as varchar) as value, concat('Only one of: ', case when k = 'F' then 'BICFI, LEI' else 'Ustrd, Strd' end) as expected from (
  select msg_id, 'F' as k from ok where ord = 8 union all select msg_id, 'R' from ok where ord = 12) r"""
FORMAT = """select msg_id, 'ERROR' as severity, 'Format Validation' as category, path, tag as element, concat('Invalid ', fmt, ' format') as message, value, concat('Pattern: ', pat) as expected
from (select *, list_extract(string_split(path, '/'), -1) as tag from ok) join (values %s) f(tagname, fmt, pat) on tag = tagname where not regexp_matches(value, pat)""" % ", ".join(
    f"('{tag}', '{fmt}', '{fixed.FORMATS[fmt]}')" for tag, fmt in fixed.TAG_FORMATS.items())
AMOUNT = """select msg_id, sev as severity, 'Amount Validation' as category, 'Document/CdtTrfTxInf/IntrBkSttlmAmt' as path, 'IntrBkSttlmAmt' as element, msg as message, v as value, cast(e as varchar) as expected from (
  select a.msg_id, unnest(list_filter([
    case when try_cast(a.value as double) < 0 then {'sev': 'ERROR', 'msg': 'Amount cannot be negative', 'v': a.value, 'e': null} end,
    case when try_cast(a.value as double) is not null and length(split_part(a.value, '.', 2)) > 2 then {'sev': 'WARNING', 'msg': concat('Amount has ', length(split_part(a.value, '.', 2)), ' decimal places (max 2 recommended)'), 'v': a.value, 'e': null} end,
    case when try_cast(a.value as double) is null then {'sev': 'ERROR', 'msg': 'Amount is not a valid number', 'v': a.value, 'e': null} end,
    case when c.value is null then {'sev': 'ERROR', 'msg': 'Missing ''Ccy'' (currency) attribute', 'v': null, 'e': null} end,
    case when not regexp_matches(c.value, '^[A-Z]{3}$') then {'sev': 'ERROR', 'msg': concat('Invalid currency code: ', c.value), 'v': c.value, 'e': '3-letter ISO currency code'} end
    ], lambda x: x is not null), recursive := true) from (select * from ok where ord = 5) a left join (select * from ok where ord = 6) c on a.msg_id = c.msg_id)"""
SINGLE = """select msg_id, 'WARNING' as severity, 'Cardinality' as category, '' as path, tag as element, concat('Element ''', tag, ''' appears ', count(*), ' times (expected 1)') as message,
  cast(null as varchar) as value, cast(null as varchar) as expected from (select *, list_extract(string_split(path, '/'), -1) as tag from ok) where tag in ('MsgId', 'CreDtTm', 'NbOfTxs') group by msg_id, tag having count(*) > 1"""
COLUMNS = ("severity", "category", "path", "element", "message", "value", "expected")

GROUP.add("validate_either_or", _o(EITHER))(_rule_query(vd.either_or_issues, *COLUMNS))
GROUP.add("validate_formats", _o(FORMAT))(_rule_query(vd.format_issues, *COLUMNS))
GROUP.add("validate_amounts", _o(AMOUNT))(_rule_query(vd.amount_issues, *COLUMNS))
GROUP.add("validate_single", _o(SINGLE))(_rule_query(vd.single_issues, *COLUMNS))

ISSUES = f""",
e as ({EITHER}), f as ({FORMAT}), m as ({AMOUNT}), s as ({SINGLE}),
i as (select msg_id, severity, category, path, element, message, value from e union all select msg_id, severity, category, path, element, message, value from f
  union all select msg_id, severity, category, path, element, message, value from m union all select msg_id, severity, category, path, element, message, value from s
  union all select distinct msg_id, 'ERROR', 'XML Parsing', '', 'Document', 'XML parsing error', null from msg_leaf where msg_id % 97 = 0)"""


def _i(body: str) -> str:
    return _o(body, ISSUES)


def _issues(spark, sf_dir):
    return vd.validate(messages(spark, sf_dir))


@GROUP.add("validate_messages", _i("select msg_id, severity, category, path, element, value from i"))
def validate_messages(spark, sf_dir):
    return _issues(spark, sf_dir).select("msg_id", "severity", "category", "path", "element", "value")


@GROUP.add("validate_by_tables", _o("""
select msg_id, 'Business Rule' as category, 'GrpHdr' as element, cast(null as varchar) as value, 'Multiple mutually exclusive elements found: MsgId, NbOfTxs' as message from ok where ord = 4
union all select msg_id, 'Format Validation', 'Ustrd', value, 'Invalid Priority format' from ok where ord = 11 and not regexp_matches(value, '^[12]-')
union all select msg_id, 'Amount Validation', 'NbOfTxs', null, 'Missing ''Ccy'' (currency) attribute' from ok where ord = 4
union all select msg_id, 'XML Parsing', 'Document', null, 'XML parsing error' from (select distinct msg_id from msg_leaf where msg_id % 97 = 0)
union all select msg_id, category, element, value, message from i where category <> 'XML Parsing'""", ISSUES))
def validate_by_tables(spark, sf_dir):
    """The built-in rules as tables, and rows of a user's own."""
    rules = vd.default_rules(spark)
    own = {"either_or": [("GrpHdr", ["MsgId", "NbOfTxs"], 1, "own rule")], "formats": [("Ustrd", "Priority", "^[12]-", None)], "amounts": [("NbOfTxs", 2)]}
    for name, more in own.items():
        rules[name] = rules[name].unionByName(spark.createDataFrame(more, vd.RULE_TABLES[name]))
    found = vd.validate_by_tables(messages(spark, sf_dir), rules)
    parse = F.col("category") == "XML Parsing"
    return found.select("msg_id", "category", "element", F.when(~parse, F.col("value")).alias("value"), F.when(parse, "XML parsing error").otherwise(F.col("message")).alias("message"))


@GROUP.add("summarise_issues", _i("""
select msg_id, sum(e) = 0 as valid, cast(sum(n) as bigint) as total_issues, cast(sum(e) as bigint) as errors, cast(sum(w) as bigint) as warnings, string_agg(concat(category, '=', n), ', ' order by category) as by_category
from (select msg_id, category, count(*) as n, count(*) filter (severity = 'ERROR') as e, count(*) filter (severity = 'WARNING') as w from i group by 1, 2) group by msg_id"""))
def summarise_issues(spark, sf_dir):
    return vd.summarise(_issues(spark, sf_dir)).drop("infos")


@GROUP.add("batch_report", _i("""
select count(*) as total, count(*) filter (n = 0) as passed, count(*) filter (n > 0) as failed, cast(sum(n) as bigint) as total_errors, printf('%.1f%%', floor(count(*) filter (n = 0) * 100.0::double / count(*) * 10 + 0.5) / 10) as pass_rate
from (select m.msg_id, count(i.msg_id) as n from (select distinct msg_id from msg_leaf) m left join i on m.msg_id = i.msg_id and i.severity = 'ERROR' group by 1)"""))
def batch_report(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    return vd.batch_report(vd.results(msgs, vd.validate(msgs))).drop("mean_time_ms")


@GROUP.add("error_digest", _i("""
select msg_id, count(*) as total, string_agg(message, '; ' order by rn) filter (rn <= 2) as first, case when count(*) > 2 then concat('... and ', count(*) - 2, ' more') else '' end as more
from (select *, row_number() over (partition by msg_id order by category, path, message, value) as rn from i where severity = 'ERROR' and category <> 'XML Parsing') group by msg_id"""))
def error_digest(spark, sf_dir):
    return vd.error_digest(_issues(spark, sf_dir).filter("category <> 'XML Parsing'"), 2)


@GROUP.add("cap_issues", _i("select msg_id, category, path, rn from (select *, row_number() over (partition by msg_id order by category, path, message, value) as rn from i) where rn <= 1".replace(", rn from", " from")))
def cap_issues(spark, sf_dir):
    return vd.cap(_issues(spark, sf_dir), 1, ["msg_id"], ["category", "path", "message", "value"]).select("msg_id", "category", "path")


@GROUP.add("validate_schema", fx.oracle("msg_leaf", """
select msg_id, msg_id % 97 <> 0 and not bool_or(ord = 2) and not bool_or(ord = 5 and (try_cast(value as decimal(18, 2)) is null or try_cast(value as double) < 0 or length(split_part(value, '.', 2)) > 2))
  and bool_or(ord = 6) and not bool_or(ord = 6 and value = 'euro') and not bool_or(ord = 7 and value = 'BAD') and not bool_or(ord = 8) and not bool_or(ord = 12) and not bool_or(ord = 3 and length(value) < 19) as valid from msg_leaf group by msg_id"""))
def validate_schema(spark, sf_dir):
    from fieldlens.sources.messages import packaged_schema

    return vd.validate_schema(messages(spark, sf_dir), packaged_schema(spark))


@GROUP.add("validate_catalog", fx.oracle("msg_leaf", """
with ok as (select * from msg_leaf where msg_id % 97 <> 0)
select msg_id, 'XSD Validation' as category, 'Document/CdtTrfTxInf/RmtInf/Strd/Ref' as path from ok where ord = 12
union all select msg_id, 'XSD Validation', 'Document/CdtTrfTxInf/RmtInf/Strd' from ok where ord = 12
union all select msg_id, 'Missing Element', 'Document/CdtTrfTxInf' from ok group by msg_id having not bool_or(ord = 9)
union all select msg_id, 'Missing Element', 'Document/GrpHdr' from ok group by msg_id
union all select msg_id, 'Pattern Mismatch', path from ok where ord = 7 and value = 'BAD'
union all select msg_id, 'Length Constraint', path from ok where ord = 10 and length(value) < 5
union all select msg_id, 'Invalid Value', path from ok where ord = 6 and value = 'euro'
union all select msg_id, 'XSD Validation', path from ok where ord = 5 and try_cast(value as double) < 0
union all select msg_id, 'XSD Validation', path from ok where ord = 5 and length(split_part(value, '.', 2)) > 2"""))
def validate_catalog(spark, sf_dir):
    # read by the catalog and by the checks: stored once, with the columns they read
    parsed = fl.flatten_xml(messages(spark, sf_dir), columns=("node_id", "path", "tag", "kind", "value", "child_tags"))
    good = checkpoint(fl.parse_guard(parsed)[0])
    # the catalog is derived from the messages themselves; one path is left out, one child is demanded
    paths = good.filter(~F.col("path").contains("/Strd")).select("path", "tag").distinct()
    wanted = good.filter("node_id = 0").select(F.lit("Document/GrpHdr/Auth").alias("path"), F.lit("Auth").alias("tag")).distinct()
    tag, none = F.col("tag"), F.lit(None).cast("string")
    cat = paths.unionByName(wanted).select(
        "path", "tag", F.when(tag.isin("Nm", "Dbtr", "Auth"), "1").otherwise("0").alias("min_occurs"),
        F.when(tag == "@Ccy", F.array(F.lit("EUR"), F.lit("USD"))).otherwise(F.array().cast("array<string>")).alias("enums"),
        F.when(tag == "BICFI", fixed.FORMATS["BIC"]).alias("pattern"), F.when(tag == "IBAN", "5").alias("min_length"),
        F.when(tag == "IBAN", "34").alias("max_length"), F.when(tag == "IntrBkSttlmAmt", "0").alias("min_value"), none.alias("max_value"),
        F.when(tag == "IntrBkSttlmAmt", "18").alias("total_digits"), F.when(tag == "IntrBkSttlmAmt", "2").alias("fraction_digits"))
    return vd.validate_catalog(good, cat).select("msg_id", "category", "path")


