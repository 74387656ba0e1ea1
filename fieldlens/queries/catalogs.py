"""Columns and statistics of one catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixed, fixtures as fx
from fieldlens.functions import lists, text as t
from fieldlens.operators import catalogs as ct, schema_diff as sd
from fieldlens.queries.base import catalog
from fieldlens.registry import Group

GROUP = Group()


def _cat(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_all")
    return cat.withColumn("pattern", F.lit("")).withColumn("depth", t.depth("path"))


# Tags of the order lines' fields stand in for element names with known meanings.
_TAGS = ["Dbtr", "CdtrAgt", "IntrBkSttlmAmt", "XAgtX", "SomeAcct", "NewAmt", "ValDt", "CreDtTmX", "RefId", "Plain"]
_TAG_SQL = "list_extract([%s], cast(l_linenumber + l_partkey as int) %% 10 + 1)" % ", ".join(f"'{x}'" for x in _TAGS)


def _tagged(spark, sf_dir):
    lines = fx.frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag"))
    tag = F.element_at(F.array(*[F.lit(x) for x in _TAGS]), ((F.col("l_linenumber") + F.col("l_partkey")) % 10 + 1).cast("int"))
    rows = lines.withColumn("tag", tag)
    parent = F.when(F.col("l_returnflag") == "R", "Document/PmtId/").when(F.col("l_returnflag") == "A", "Document/Other/").otherwise("Document/Q/")
    return rows.withColumn("path", F.concat(parent, "tag"))


_ENT = "case " + " ".join(f"when tag = '{k}' then '{v}'" for k, v in fixed.ENTITIES.items()) + " " + " ".join(
    f"when contains(path, '{k}') then '{v}'" for k, v in fixed.ENTITIES.items()) + """ when contains(tag, 'Agt') then 'Agent (Financial Institution)' when contains(tag, 'Acct') then 'Account Information'
  when contains(tag, 'Amt') then 'Amount' when contains(tag, 'Dt') and not contains(tag, 'Tm') then 'Date' when contains(tag, 'Id') then 'Identifier' else '' end"""
_TAGGED = f"tg as (select *, concat(case l_returnflag when 'R' then 'Document/PmtId/' when 'A' then 'Document/Other/' else 'Document/Q/' end, tag) as path from (select l_orderkey, l_partkey, l_linenumber, l_returnflag, {_TAG_SQL} as tag from lineitem))"


@GROUP.add("business_entity", f"with {_TAGGED}\nselect l_orderkey, l_partkey, l_linenumber, path, {_ENT} as entity from tg")
def business_entity(spark, sf_dir):
    return _tagged(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", "path", ct.business_entity().alias("entity"))


@GROUP.add("business_entity_table", f"""with {_TAGGED}
select l_orderkey, l_partkey, l_linenumber, tag, case when tag = 'Dbtr' then 'd' when contains(path, 'Agt') then 'a' when contains(path, 'PmtId') then 'p' when contains(tag, 'Acct') then 'Account Information'
  when contains(tag, 'Amt') then 'Amount' when contains(tag, 'Dt') and not contains(tag, 'Tm') then 'Date' when contains(tag, 'Id') then 'Identifier' else '' end as entity from tg""")
def business_entity_table(spark, sf_dir):
    entities = spark.createDataFrame([("Dbtr", "d", 1), ("Agt", "a", 2), ("PmtId", "p", 3)], "key string, entity string, ord int")
    return ct.business_entity_by(_tagged(spark, sf_dir), entities).select("l_orderkey", "l_partkey", "l_linenumber", "tag", "entity")


@GROUP.add("sample_values", fx.oracle("cat_all", """
select schema_id, path, case when enums <> '' then split_part(enums, ',', 1) when contains(lower(type), 'date') then '2024-01-15' else concat('[', tag, ']') end as sample from cat_all"""))
def sample_values(spark, sf_dir):
    return _cat(spark, sf_dir).select("schema_id", "path", ct.mapping_sample().alias("sample"))


@GROUP.add("documented_samples", fx.oracle("cat_all", """
select schema_id, path, case when enums <> '' then split_part(enums, ',', 1) when type = 'ISODate' then '2024-01-15' when contains(type, 'Text') then concat('Sample', tag) else concat('<', type, '>') end as sample from cat_all"""))
def documented_samples(spark, sf_dir):
    rows = _cat(spark, sf_dir).withColumn("max_length", F.lit(None).cast("string")).withColumn("min_value", F.lit(None).cast("string"))
    return rows.select("schema_id", "path", ct.documented_sample("2024-01-15T10:30:00").alias("sample"))


@GROUP.add("quick_reference", fx.oracle("cat_all", """
select schema_id, path, tag, case when min_occurs <> '0' then 'Yes' else 'No' end as required, field_class from cat_all where len(string_split(path, '/')) - 1 <= 4"""))
def quick_reference(spark, sf_dir):
    return ct.quick_reference(_cat(spark, sf_dir), 4)


@GROUP.add("mapping_template", fx.oracle("cat_v2", """
select path, len(string_split(path, '/')) - 1 as level, concat(repeat('  ', len(string_split(path, '/')) - 1), tag) as element, case when min_occurs <> '0' then '✓' else '' end as mandatory,
  replace(enums, ',', ', ') as pattern_or_codes, case when field_class = 'YELLOW' then '✓' else '' end as yellow, status from (select *, '' as status from cat_v2) where min_occurs <> '0'"""))
def mapping_template(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_v2").withColumn("pattern", F.lit(""))
    return ct.mapping_template(cat, mandatory_only=True).select("path", "level", "element", "mandatory", "pattern_or_codes", "yellow", "status")


@GROUP.add("mapping_stats", fx.oracle("cat_all", """
select schema_id, count(*) as total, count(*) filter (min_occurs <> '0') as mandatory, count(*) filter (min_occurs = '0') as optional, count(*) filter (field_class = 'YELLOW') as yellow, count(*) filter (field_class = 'WHITE') as white from cat_all group by 1"""))
def mapping_stats(spark, sf_dir):
    return ct.mapping_stats(_cat(spark, sf_dir))


@GROUP.add("schema_stats", fx.oracle("cat_all", """
select *, cast(floor(required * 100.0::double / elements + 0.5) as bigint) as required_pct, cast(floor(optional * 100.0::double / elements + 0.5) as bigint) as optional_pct, cast(floor(unbounded * 100.0::double / elements + 0.5) as bigint) as unbounded_pct from (
select schema_id, count(*) as elements, 0 as attributes, count(*) filter (min_occurs <> '0') as required, count(*) filter (min_occurs = '0') as optional, count(*) filter (max_occurs = 'unbounded') as unbounded,
  max(len(string_split(path, '/')) - 1) as max_depth, count(distinct type) as types from cat_all group by 1)"""))
def schema_stats(spark, sf_dir):
    return ct.schema_stats(_cat(spark, sf_dir))


@GROUP.add("type_usage", fx.oracle("cat_all", "select type, count(*) as n from cat_all group by 1 order by n desc, type limit 3"))
def type_usage(spark, sf_dir):
    return ct.type_usage(_cat(spark, sf_dir), 3)


@GROUP.add("head_with_more", fx.oracle("cat_v1", """
select tag, count(*) as n, concat(string_agg(path, ', ' order by path) filter (rn <= 3), case when count(*) > 3 then concat(' (+', count(*) - 3, ' more)') else '' end) as paths
from (select *, row_number() over (partition by tag order by path) as rn from cat_v1) group by tag"""))
def head_with_more(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_v1")
    first = sd.first_per_group(cat, ["tag"], ["path"], "path", 3)
    return cat.groupBy("tag").agg(F.count("*").alias("n")).join(first, "tag").select(
        "tag", "n", lists.head_with_more(F.col("sample"), F.col("n"), 3).alias("paths"))


@GROUP.add("text_functions", r"""
select page_id, regexp_replace(url, '^(\{[^}]*\}|[^:/{}]*:)', '') as bare, list_extract(string_split(url, '/'), -1) as last, regexp_replace(url, '/?[^/]*$', '') as parent, len(string_split(url, '/')) - 1 as depth,
  case when length(url) > 20 then concat(left(url, 20), '…') else url end as short, case when length(url) % 3 = 0 then '1 .. 35' when length(url) % 3 = 1 then '' else '2 .. 35' end as len_text,
  rpad(left(url, 5), 8, 'X') as padded, case when page_id % 2 = 0 then 'Yes' else 'No' end as flag, concat(page_id % 2, '..', page_id % 5) as mult, cast(page_id % 2 as varchar) as low, '/a~b' as pointer,
  trim(regexp_replace(html, '\s+', ' ', 'g'), ' ') as squeezed from pages""")
def text_functions(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    n = F.length("url") % 3
    lo = F.when(n == 2, "2").otherwise("")
    hi = F.when(n == 1, "").otherwise("35")
    mult = t.multiplicity((F.col("page_id") % 2).cast("string"), (F.col("page_id") % 5).cast("string"))
    return pages.select(
        "page_id", t.strip_ns("url").alias("bare"), t.last_segment("url").alias("last"), t.parent_path("url").alias("parent"), t.depth("url").alias("depth"),
        t.truncate("url", 20, "…").alias("short"), t.length_text(lo, hi).alias("len_text"), t.pad_or_cut(F.left("url", F.lit(5)), F.lit(8), F.lit(8)).alias("padded"),
        t.yes_no(F.col("page_id") % 2 == 0).alias("flag"), mult.alias("mult"), t.min_of(mult).alias("low"), t.pointer_unescape(F.lit("~1a~0b")).alias("pointer"),
        t.collapse_ws("html").alias("squeezed"))


@GROUP.add("format_checks", """
select o_orderkey, regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') as iso_date, regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}') as iso_datetime, length(split_part(p, '.', 2)) as decimals, try_cast(p as double) as number,
  case when o_orderkey % 3 = 0 then '0.0%' else printf('%.1f%%', floor((o_orderkey % 7) * 100.0::double / 7 * 10 + 0.5) / 10) end as pct
from (select o_orderkey, case when o_orderkey % 2 = 0 then cast(cast(o_orderdate as date) as varchar) else concat(cast(o_orderdate as date), 'T00:00:00Z') end as d,
  case when o_orderkey % 5 = 0 then 'n/a' else cast(cast(o_totalprice as decimal(18, 2)) as varchar) end as p from orders)""")
def format_checks(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.concat(day, F.lit("T00:00:00Z")))
    p = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    n = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 7)
    return orders.select("o_orderkey", t.matches(d, fixed.FORMATS["ISODate"]).alias("iso_date"), t.matches(d, fixed.FORMATS["ISODateTime"]).alias("iso_datetime"),
                         t.decimals(p).alias("decimals"), t.to_number(p).alias("number"), t.pct(n, F.lit(7)).alias("pct"))


@GROUP.add("list_functions", """
select o_orderkey, len(list_filter(string_split(s, ','), lambda x: trim(x) <> '')) as n_ranges,
  array_to_string(list_transform(string_split(s, ','), lambda x: concat(split_part(x, '-', 1), ':', case when contains(x, '-') then split_part(x, '-', 2) else x end)), ' ') as ranges,
  case when o_orderkey % 2 = 0 then 1.0 else 0.75 end as similarity
from (select o_orderkey, concat(o_orderkey % 5 + 1, '-', o_orderkey % 5 + 4, ',', o_orderkey % 9) as s from orders)""")
def list_functions(spark, sf_dir):
    k = F.col("o_orderkey")
    spec = F.concat((k % 5 + 1).cast("string"), F.lit("-"), (k % 5 + 4).cast("string"), F.lit(","), (k % 9).cast("string"))
    ranges = lists.parse_ranges(spec)
    shown = F.array_join(F.transform(ranges, lambda r: F.concat_ws(":", r["first"].cast("string"), r["last"].cast("string"))), " ")
    other = F.when(k % 2 == 0, F.lit("a/b/c/d")).otherwise(F.lit("a/x/c/d"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.size(ranges).alias("n_ranges"), shown.alias("ranges"),
                                                    lists.path_similarity(F.lit("a/b/c/d"), other).alias("similarity"))
