"""Three versions of a schema together."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.operators import schema_diff as sd, versions as vs
from fieldlens.queries.base import catalog
from fieldlens.queries.schemas import diff_rows
from fieldlens.registry import Group

GROUP = Group()
IDS = ("v1", "v2", "v3")

PAIRED = """l as (select 'v1 -> v2' as pair, * from cat_v1 union all select 'v2 -> v3', * from cat_v2),
r as (select 'v1 -> v2' as pair, * from cat_v2 union all select 'v2 -> v3', * from cat_v3),
"""
DIFFS = PAIRED + diff_rows("l", "r", "the new version", by="pair", on=" and a.pair = b.pair", facets=False)


def _o(body: str) -> str:
    return fx.oracle("cat_all", f"with {DIFFS}\n{body}")


def _diffs(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_all")
    return cat, vs.consecutive_diffs(cat, vs.pair_consecutive(vs.schema_list(cat)))


@GROUP.add("pair_consecutive", fx.oracle("cat_all", """
select schema_id as left_id, nxt as right_id from (
  select schema_id, lead(schema_id) over (order by schema_id) as nxt from (select distinct schema_id from cat_all)) where nxt is not null"""))
def pair_consecutive(spark, sf_dir):
    return vs.pair_consecutive(vs.schema_list(catalog(spark, sf_dir, "cat_all"))).select("left_id", "right_id")


@GROUP.add("consecutive_diffs", _o("select pair, path, change_type, severity, old_value, new_value from d"))
def consecutive_diffs(spark, sf_dir):
    return _diffs(spark, sf_dir)[1].select("pair", "path", "change_type", "severity", "old_value", "new_value")


@GROUP.add("schema_matrix", fx.oracle("cat_all", "select path, %s from cat_all group by path" % ", ".join(
    f"bool_or(schema_id = '{s}') as {s}_present, max(case when schema_id = '{s}' then type end) as {s}_type, max(case when schema_id = '{s}' then min_occurs end) as {s}_min_occurs, max(case when schema_id = '{s}' then max_occurs end) as {s}_max_occurs, max(case when schema_id = '{s}' then field_class end) as {s}_field_class"
    for s in IDS)))
def schema_matrix(spark, sf_dir):
    return vs.matrix(catalog(spark, sf_dir, "cat_all"), IDS)


@GROUP.add("class_evolution", fx.oracle(("cat_v1", "cat_v2", "cat_v3"), """
select path, list_extract(string_split(path, '/'), -1) as element,
  concat(coalesce(a, 'N/A'), ', ', coalesce(b, 'N/A'), ', ', coalesce(c, 'N/A')) as classes,
  case when x then 'Yes' else 'No' end as changed,
  case when x then concat(coalesce(a, '?'), ' → ', coalesce(b, '?'), ' → ', coalesce(c, '?')) else 'Stable' end as evolution
from (select *, coalesce(a <> b, false) or coalesce(b <> c, false) or coalesce(a <> c, false) as x from (
  select p.path, v1.field_class as a, v2.field_class as b, v3.field_class as c
  from (select path from cat_v1 union select path from cat_v2 union select path from cat_v3) p
  left join cat_v1 v1 on p.path = v1.path left join cat_v2 v2 on p.path = v2.path left join cat_v3 v3 on p.path = v3.path))
where a in ('YELLOW', 'WHITE') or b in ('YELLOW', 'WHITE') or c in ('YELLOW', 'WHITE')"""))
def class_evolution(spark, sf_dir):
    return vs.evolution(catalog(spark, sf_dir, "cat_all"), IDS)


@GROUP.add("class_counts", fx.oracle("cat_all", """
select schema_id, count(*) filter (field_class = 'YELLOW') as yellow, count(*) filter (field_class = 'WHITE') as white, count(*) filter (field_class = 'NA') as na from cat_all group by 1"""))
def class_counts(spark, sf_dir):
    return vs.class_counts(catalog(spark, sf_dir, "cat_all"))


@GROUP.add("class_change_count", fx.oracle("cat_all", """
select count(*) as n from (select path from cat_all where field_class <> 'NA' group by path having count(distinct field_class) > 1)"""))
def class_change_count(spark, sf_dir):
    return vs.class_change_count(catalog(spark, sf_dir, "cat_all"))


@GROUP.add("change_summary", _o("""
, x as (select *, concat(change_type, ': ', case when old_value = '' then 'N/A' else left(old_value, 20) end, ' → ', case when new_value = '' then 'N/A' else left(new_value, 20) end) as txt,
  list_position(['ADDED', 'REMOVED', 'TYPE_CHANGED', 'CARDINALITY_CHANGED', 'RESTRICTION_CHANGED', 'FIELD_CLASS_CHANGED', 'ENUMERATION_CHANGED', 'RULEBOOK_CHANGED', 'USAGE_RULES_CHANGED', 'FIXED_VALUE_CHANGED', 'DEFAULT_VALUE_CHANGED'], change_type) as o from d),
s as (select path, array_to_string(list_sort(list_distinct(list(change_type))), ', ') as t,
  case when bool_or(severity = 'HIGH') then 'HIGH' when bool_or(severity = 'MEDIUM') then 'MEDIUM' else 'LOW' end as m, list(txt order by pair, o, txt) as l from x group by path)
select p.path, coalesce(t, 'No Change') as change_types, coalesce(m, '') as max_severity,
  coalesce(concat(array_to_string(l[1:3], ' | '), case when len(l) > 3 then concat(' | ...+', len(l) - 3, ' more') else '' end), '') as summary
from (select distinct path from cat_all) p left join s on p.path = s.path""".replace("\n, x as", "\n,x as")).replace("\n\n,", "\n,"))
def change_summary(spark, sf_dir):
    cat, diffs = _diffs(spark, sf_dir)
    return vs.change_summary(cat, diffs)


@GROUP.add("pair_counts", _o("""
select coalesce(pair, 'TOTAL') as pair, count(*) as n, count(*) filter (change_type = 'ADDED') as added, count(*) filter (change_type = 'REMOVED') as removed,
  count(*) filter (change_type = 'FIELD_CLASS_CHANGED') as class_changes from d group by rollup (pair)"""))
def pair_counts(spark, sf_dir):
    return sd.pair_counts(_diffs(spark, sf_dir)[1])


@GROUP.add("issue_rollup", _o("""
select pair, severity, change_type, count(*) as n,
  concat(array_to_string(list(path order by rn) filter (rn <= 5), ', '), case when count(*) > 5 then concat(' ... and ', count(*) - 5, ' more') else '' end) as paths
from (select *, row_number() over (partition by pair, severity, change_type order by path, old_value) as rn from d) group by 1, 2, 3"""))
def issue_rollup(spark, sf_dir):
    return sd.issue_rollup(_diffs(spark, sf_dir)[1])


@GROUP.add("all_paths", fx.oracle("cat_all", """
select path, min(schema_id) as first_schema, arg_min(seq, schema_id) as first_seq from cat_all group by path"""))
def all_paths(spark, sf_dir):
    return vs.all_paths(catalog(spark, sf_dir, "cat_all"))


@GROUP.add("common_paths", fx.oracle(("cat_v1", "cat_v3"), "select path from cat_v1 intersect select path from cat_v3"))
def common_paths(spark, sf_dir):
    return vs.common_paths(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v3"))


@GROUP.add("only_left_right", fx.oracle(("cat_v1", "cat_v3"), """
select 'left' as side, path from (select path from cat_v1 except select path from cat_v3)
union all select 'right', path from (select path from cat_v3 except select path from cat_v1)"""))
def only_left_right(spark, sf_dir):
    a, b = catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v3")
    return (vs.only_left(a, b).select(F.lit("left").alias("side"), "path")
            .unionByName(vs.only_left(b, a).select(F.lit("right").alias("side"), "path")))
