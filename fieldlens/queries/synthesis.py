"""Synthetic messages: one per customer, from the catalog of the payment messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.operators import flatten as fl, synth as sy, validate as vd
from fieldlens.registry import Group
from fieldlens.session import checkpoint
from fieldlens.sources.dimensions import PROFILE_SCHEMA

GROUP = Group()
NOW = datetime(2024, 1, 15, 10, 30, 0)


def _catalog(spark, sf_dir):
    """Paths of the messages, with a currency attribute, a code choice and a repeatable block."""
    paths = fx.frame(spark, sf_dir, "msg_paths").unionByName(spark.sql("""
        select * from values ('Document/CdtTrfTxInf/IntrBkSttlmAmt/@Ccy', 6), ('Document/CdtTrfTxInf/Purp', 20), ('Document/CdtTrfTxInf/Purp/Cd', 21),
        ('Document/CdtTrfTxInf/Purp/Prtry', 22), ('Document/CdtTrfTxInf/SttlmMtd', 23) t(path, seq)"""))
    tag = F.element_at(F.split("path", "/"), -1)
    none = F.lit(None).cast("string")
    rows = paths.withColumn("tag", tag).withColumn("is_root", ~F.col("path").contains("/"))
    order = F.col("seq") * 10 + F.size(F.split("path", "/"))
    # two schemas with the same fields
    return rows.withColumn("schema_id", F.explode(F.array(F.lit("m"), F.lit("n")))).select(
        "schema_id", "path", "tag", order.alias("seq"), F.when(tag.isin("SttlmMtd", "LEI"), "0").otherwise("1").alias("min_occurs"),
        F.when(tag == "CdtTrfTxInf", "unbounded").otherwise("1").alias("max_occurs"), F.when(tag.isin("Nm", "SttlmMtd"), "YELLOW").otherwise("NA").alias("field_class"),
        F.when(tag == "NbOfTxs", "1").otherwise("").alias("fixed"), tag.isin("Cd", "Prtry").alias("in_choice"), F.when(tag.isin("Cd", "Prtry"), "c").alias("choice_key"),
        F.when(tag == "IntrBkSttlmAmt", "Amount").when(tag == "CreDtTm", "ISODateTime").otherwise("Max35Text").alias("type"), F.array().cast("array<string>").alias("enums"),
        none.alias("pattern"), none.alias("min_length"), F.when(~tag.startswith("@"), "35").alias("max_length"), none.alias("min_value"), none.alias("max_value"), none.alias("fraction_digits"))


def _profiles(spark, sf_dir):
    seg = fx.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    lits = {"debtor_iban": "DE89370400440532013000", "debtor_bic": "DEUTDEFF", "amount_min": 10.0, "amount_max": 20.0, "currency": "EUR"}
    columns = [c.strip().rsplit(" ", 1) for c in PROFILE_SCHEMA.split(",")]
    pick = lambda n, t: F.col("name") if n == "name" else F.concat(F.lit("Party "), "name") if n == "debtor_name" else F.lit(lits.get(n)).cast(t).alias(n)
    return seg.select(*[pick(n, t).alias(n) for n, t in columns])


def _rows(spark, sf_dir, catalog=None, profiles=None, **kw):
    messages = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("msg_id"), F.when(F.col("c_custkey") % 2 == 0, "m").otherwise("n").alias("schema_id"), F.col("c_mktsegment").alias("profile"))
    catalog = checkpoint(_catalog(spark, sf_dir)) if catalog is None else catalog
    return sy.synthesize(messages, catalog, _profiles(spark, sf_dir) if profiles is None else profiles, seed=7, now=NOW, **kw)


# without repetition and random texts the rows are known
@GROUP.add("synthesize", """
select c_custkey as msg_id, path, case path when 'Document/GrpHdr/NbOfTxs' then '1' when 'Document/CdtTrfTxInf/Dbtr/Nm' then concat('Party ', c_mktsegment) when 'Document/CdtTrfTxInf/DbtrAcct/Id/IBAN' then 'DE89370400440532013000'
  when 'Document/CdtTrfTxInf/DbtrAgt/FinInstnId/BICFI' then 'DEUTDEFF' when 'Document/CdtTrfTxInf/IntrBkSttlmAmt/@Ccy' then 'EUR' when 'Document/CdtTrfTxInf/Purp/Cd' then 'SALA' when 'Document/CdtTrfTxInf/RmtInf/Ustrd' then 'Payment for invoice 12345'
  when 'Document/GrpHdr/CreDtTm' then '2024-01-15T10:30:00.000Z' when 'Document/CdtTrfTxInf/SttlmMtd' then 'CLRG' end as value
from customer cross join (select unnest(['Document', 'Document/GrpHdr', 'Document/GrpHdr/MsgId', 'Document/GrpHdr/CreDtTm', 'Document/GrpHdr/NbOfTxs', 'Document/CdtTrfTxInf', 'Document/CdtTrfTxInf/IntrBkSttlmAmt',
  'Document/CdtTrfTxInf/IntrBkSttlmAmt/@Ccy', 'Document/CdtTrfTxInf/DbtrAgt', 'Document/CdtTrfTxInf/DbtrAgt/FinInstnId', 'Document/CdtTrfTxInf/DbtrAgt/FinInstnId/BICFI', 'Document/CdtTrfTxInf/Dbtr', 'Document/CdtTrfTxInf/Dbtr/Nm',
  'Document/CdtTrfTxInf/DbtrAcct', 'Document/CdtTrfTxInf/DbtrAcct/Id', 'Document/CdtTrfTxInf/DbtrAcct/Id/IBAN', 'Document/CdtTrfTxInf/RmtInf', 'Document/CdtTrfTxInf/RmtInf/Ustrd', 'Document/CdtTrfTxInf/Purp', 'Document/CdtTrfTxInf/Purp/Cd', 'Document/CdtTrfTxInf/SttlmMtd']) as path)""")
def synthesize(spark, sf_dir):
    rows = _rows(spark, sf_dir, repeat=0.0)
    random = F.col("tag").isin("MsgId", "IntrBkSttlmAmt")
    return rows.select("msg_id", "path", F.when(~random, F.col("value")).alias("value"))


@GROUP.add("synth_amounts", "select c_custkey as msg_id, true as in_range, true as two_decimals, true as same_again from customer")
def synth_amounts(spark, sf_dir):
    amount = lambda: _rows(spark, sf_dir, repeat=0.0).filter("tag = 'IntrBkSttlmAmt'").select("msg_id", "value")
    again = amount().repartition(3).withColumnRenamed("value", "v2")
    number = F.col("value").cast("double")
    return amount().join(again, "msg_id").select("msg_id", ((number >= 10) & (number <= 20)).alias("in_range"), F.col("value").rlike(r"^\d+\.\d{2}$").alias("two_decimals"), (F.col("value") == F.col("v2")).alias("same_again"))


@GROUP.add("synthesis_report", "select case when c_custkey % 2 = 0 then 'm' else 'n' end as schema_id, count(*) as messages, count(*) as choices, count(*) * 2 as rules_applied, count(*) * 2 as yellow_fields from customer group by 1")
def synthesis_report(spark, sf_dir):
    return sy.synthesis_report(_rows(spark, sf_dir, repeat=0.0)).drop("fields")


@GROUP.add("synthesis_report_checked", """
select case when c_custkey % 2 = 0 then 'm' else 'n' end as schema_id, case when c_mktsegment < 'C' then 'Custom profile' else concat('Tests of ', c_mktsegment) end as profile_used, count(*) as messages, count(*) as choices,
  count(*) * 2 as rules_applied, count(*) * 2 as yellow_fields, sum(case when c_mktsegment in ('BUILDING', 'MACHINERY') then 1 else 0 end)::bigint as validation_errors from customer group by 1, 2""")
def synthesis_report_checked(spark, sf_dir):
    """Report per schema and profile; two profiles carry an IBAN that no message may have."""
    faulty = F.when(F.col("name").isin("BUILDING", "MACHINERY"), "0000").otherwise(F.col("debtor_iban"))
    profiles = _profiles(spark, sf_dir).withColumn("debtor_iban", faulty).withColumn("description", F.when(F.col("name") >= "C", F.concat(F.lit("Tests of "), "name")))
    rows = checkpoint(_rows(spark, sf_dir, profiles=profiles, repeat=0.0))
    return sy.synthesis_report(rows, ("schema_id", "profile_used"), vd.validate(sy.synthetic_messages(rows))).drop("fields")


PICKS = (("RemittanceInformation", ("Strd", "Ustrd"), "Ustrd"), ("RmtInf", ("Strd",), "Strd"), ("OrgId", ("AnyBIC", "LEI"), None), ("PrvtId", ("DtAndPlcOfBirth", "Othr"), "Othr"), ("FinInstnId", ("BICFI", "LEI"), "BICFI"))


@GROUP.add("either_or_picks", f"""
select c_custkey as msg_id, concat('P[1]/', t, '[1]') as place, o as options, p as preferred, true as as_told from customer
cross join (values {', '.join(f"('{n}', '{','.join(o)}', {'NULL' if p is None else chr(39) + p + chr(39)})" for n, o, p in PICKS)}) v(t, o, p)""")
def either_or_picks(spark, sf_dir):
    """One child of every exclusive group: the preferred one where it is there, one drawn by hash otherwise; logged with its options."""
    fields = [("P", "P", 0)]
    for k, (name, options, _) in enumerate(PICKS, 1):
        fields += [(f"P/{name}", name, 10 * k)] + [(f"P/{name}/{o}", o, 10 * k + i) for i, o in enumerate(options, 1)]
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame(fields, "path string, tag string, seq int").withColumn("schema_id", F.explode(F.array(F.lit("m"), F.lit("n"))))
    rules = rows.select("schema_id", "path", "tag", "seq", F.lit("1").alias("min_occurs"), F.lit("1").alias("max_occurs"), F.lit("NA").alias("field_class"), F.lit("").alias("fixed"), F.lit(False).alias("in_choice"),
                        none.alias("choice_key"), F.lit("Text").alias("type"), F.array().cast("array<string>").alias("enums"), *[none.alias(c) for c in ("pattern", "min_length", "max_length", "min_value", "max_value", "fraction_digits")])
    log = sy.selections(_rows(spark, sf_dir, catalog=checkpoint(rules)))
    preferred = F.create_map(*[F.lit(x) for n, _, p in PICKS for x in (n, p or "")])[F.regexp_extract("place", r"/([^/\[]+)\[1\]$", 1)]
    preferred = F.when(preferred != "", preferred)
    told = F.when(preferred.isNotNull(), F.col("picked") == preferred).otherwise(F.array_contains("options", F.col("picked")))
    return log.select("msg_id", "place", F.array_join("options", ",").alias("options"), preferred.alias("preferred"), told.alias("as_told"))


@GROUP.add("synth_mandatory", """
select c_custkey as msg_id, 19 + 2 as n_fields from customer""")
def synth_mandatory(spark, sf_dir):
    rows = _rows(spark, sf_dir, mode="mandatory", repeat=0.0)
    return rows.groupBy("msg_id").agg(F.count("*").cast("int").alias("n_fields"))


@GROUP.add("synth_is_valid", "select count(*) as messages, 0 as issues from customer")
def synth_is_valid(spark, sf_dir):
    """Synthetic messages pass every message rule, repetitions included."""
    xml = sy.synthetic_messages(_rows(spark, sf_dir))
    marks = xml.select(F.lit(1).alias("m"), F.lit(0).alias("i")).unionByName(vd.validate(xml).select(F.lit(0).alias("m"), F.lit(1).alias("i")))
    return marks.agg(F.sum("m").alias("messages"), F.sum("i").cast("int").alias("issues"))


PATTERNS = ("[A-Z]{3}[0-9]{2}", "[0-9]{5}-[0-9]{3}", "[A-Z]{2}[0-9]{4}", "[a-zA-Z0-9]{1,12}", "(AB|CD)[0-9]{2}", "((((x))))y{2}", r"\+[0-9]{1,3}-[0-9()+\-]{1,30}")


@GROUP.add("synth_patterns", f"""
select schema_id, path, n as n_values, n as n_matching, 0 as catalog_issues
from (select case when c_custkey % 2 = 0 then 'm' else 'n' end as schema_id, count(*) as n from customer group by 1)
cross join (select concat('P/F', i) as path from range(1, {len(PATTERNS) + 1}) t(i))""")
def synth_patterns(spark, sf_dir):
    """Values of fields with patterns match them, and messages made of such fields pass the catalog they come from."""
    none = F.lit(None).cast("string")
    fields = spark.createDataFrame([("P", "P", 0, None)] + [(f"P/F{k}", f"F{k}", k, p) for k, p in enumerate(PATTERNS, 1)], "path string, tag string, seq int, pattern string")
    catalog = checkpoint(fields.withColumn("schema_id", F.explode(F.array(F.lit("m"), F.lit("n")))).select(
        "schema_id", "path", "tag", "seq", F.lit("1").alias("min_occurs"), F.lit("1").alias("max_occurs"), F.lit("NA").alias("field_class"), F.lit("").alias("fixed"),
        F.lit(False).alias("in_choice"), none.alias("choice_key"), F.lit("Text").alias("type"), F.array().cast("array<string>").alias("enums"), "pattern",
        *[none.alias(c) for c in ("min_length", "max_length", "min_value", "max_value", "fraction_digits", "total_digits")]))
    messages = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("msg_id"), F.when(F.col("c_custkey") % 2 == 0, "m").otherwise("n").alias("schema_id"), F.col("c_mktsegment").alias("profile"))
    rows = checkpoint(sy.synthesize(messages, catalog.drop("total_digits"), _profiles(spark, sf_dir), seed=7, now=NOW))
    own = catalog.filter("schema_id = 'm'")
    nodes = fl.parse_guard(fl.flatten_xml(sy.synthetic_messages(rows)))[0]
    issues = vd.validate_catalog(nodes, own).groupBy("path").count()
    told = rows.filter("value is not null").join(F.broadcast(own.select("path", vd.xsd_regex("pattern").alias("regex"))), "path")  # the fields of one schema
    counts = told.groupBy("schema_id", "path").agg(F.count("*").alias("n_values"), F.count_if(F.rlike("value", "regex")).alias("n_matching"))
    return counts.join(issues, "path", "left").select("schema_id", "path", "n_values", "n_matching", F.coalesce("count", F.lit(0)).cast("int").alias("catalog_issues"))


@GROUP.add("synth_repetitions")
def synth_repetitions(spark, sf_dir):
    """How many messages carry a second transaction."""
    nodes = fl.flatten_xml(sy.synthetic_messages(_rows(spark, sf_dir)))
    return nodes.filter("tag = 'CdtTrfTxInf' and tag_occ = 1").groupBy("tag_total").agg(F.count("*").alias("messages"))
