"""Message differences, mappings between schemas and migrated messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.operators import flatten as fl, mapping as mp, message_diff as md
from fieldlens.queries.base import catalog
from fieldlens.queries.messages import messages
from fieldlens.registry import Group
from fieldlens.session import checkpoint

GROUP = Group()
NOW = datetime(2024, 1, 15, 10, 30, 0)


def _pair(spark, sf_dir):
    return [messages(spark, sf_dir, name, damaged=False) for name in ("msg_leaf", "msg_leaf_b")]


# Children of GrpHdr shift when CreDtTm (ord 3) is missing, so positions there pair different tags.
HDR = """ha as (select *, row_number() over (partition by msg_id order by ord) as i, list_extract(string_split(path, '/'), -1) as tag from msg_leaf where path like '%/GrpHdr/%'),
hb as (select *, row_number() over (partition by msg_id order by ord) as i, list_extract(string_split(path, '/'), -1) as tag from msg_leaf_b where path like '%/GrpHdr/%'),
nodup as (select msg_id from msg_leaf where ord = 1)"""
ORDERED = f"""with {HDR},
h as (select coalesce(a.msg_id, b.msg_id) as msg_id, coalesce(a.i, b.i) as i, a.tag as atag, b.tag as btag, a.value as av, b.value as bv from ha a full join hb b on a.msg_id = b.msg_id and a.i = b.i),
d as (
select msg_id, case when atag is null then 'added' when btag is null then 'removed' else 'changed' end as diff_type,
  case when atag is null or btag is null then concat('Document/GrpHdr/', coalesce(atag, btag), '[', i, ']') else concat('Document/GrpHdr/', atag) end as path,
  case when atag is null then null when btag is null then concat('<', atag, '>', av, '</', atag, '>') when atag <> btag then atag else av end as left_value,
  case when btag is null then null when atag is null then concat('<', btag, '>', bv, '</', btag, '>') when atag <> btag then btag else bv end as right_value
from h where atag is distinct from btag or av is distinct from bv
union all select a.msg_id, 'changed', a.path, a.value, b.value from msg_leaf a join msg_leaf_b b on a.msg_id = b.msg_id and a.ord = b.ord and a.ord > 6 where trim(a.value, ' ') <> trim(b.value, ' ')
union all select a.msg_id, case when b.msg_id is null then 'removed' else 'changed' end, a.path, a.value, b.value from msg_leaf a left join msg_leaf_b b on a.msg_id = b.msg_id and b.ord = 6 where a.ord = 6 and a.value is distinct from b.value
union all select b.msg_id, 'added', concat('Document/CdtTrfTxInf/Purp[', (select count(distinct split_part(path, '/', 3)) from msg_leaf l where l.msg_id = b.msg_id and l.path like '%CdtTrfTxInf%') + 1, ']'), null, '<Purp>[Cd]</Purp>' from msg_leaf_b b where b.ord = 13)"""


@GROUP.add("message_diff_ordered", fx.oracle("msg_leaf_b", ORDERED + "\nselect * from d"))
def message_diff_ordered(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return md.compare_messages(a, b).select("msg_id", "diff_type", "path", "left_value", "right_value")


@GROUP.add("message_diff_stats", fx.oracle("msg_leaf_b", ORDERED + """
select m.msg_id, count(d.msg_id) = 0 as identical, count(*) filter (diff_type = 'added') as added, count(*) filter (diff_type = 'removed') as removed, count(*) filter (diff_type = 'changed') as changed
from (select distinct msg_id from msg_leaf) m left join d on m.msg_id = d.msg_id group by 1"""))
def message_diff_stats(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return md.message_diff_stats(md.compare_messages(a, b), fx.frame(spark, sf_dir, "msg_leaf").select("msg_id").distinct())


# Without order, GrpHdr pairs by MsgId (always equal); its leaf children pair by tag and position, so a
# removed CreDtTm renames the key of NbOfTxs. Accounts are identified by IBAN one level up.
UNORDERED = f"""with {HDR}
select msg_id, 'removed' as diff_type, concat('Document/GrpHdr/', tag, '[', i - 1, ']') as path from ha where not exists (select 1 from hb where hb.msg_id = ha.msg_id and hb.tag = ha.tag and hb.i = ha.i)
union all select msg_id, 'added', concat('Document/GrpHdr/', tag, '[', i - 1, ']') from hb where not exists (select 1 from ha where hb.msg_id = ha.msg_id and hb.tag = ha.tag and hb.i = ha.i)
union all select a.msg_id, case when s = 'a' then 'removed' else 'added' end, concat('Document/CdtTrfTxInf/DbtrAcct/Id[IBAN=', case when s = 'a' then a.value else b.value end, ']')
  from msg_leaf a join msg_leaf_b b on a.msg_id = b.msg_id and a.ord = 10 and b.ord = 10 and a.value <> b.value cross join (values ('a'), ('b')) v(s)
union all select a.msg_id, 'changed', a.path from msg_leaf a join msg_leaf_b b on a.msg_id = b.msg_id and a.ord = b.ord and a.ord in (5, 7, 8, 9, 11, 12) where trim(a.value, ' ') <> trim(b.value, ' ')
union all select b.msg_id, 'added', concat('Document/CdtTrfTxInf/Purp[', (select count(distinct split_part(path, '/', 3)) from msg_leaf l where l.msg_id = b.msg_id and l.path like '%CdtTrfTxInf%'), ']') from msg_leaf_b b where b.ord = 13"""


@GROUP.add("message_diff_unordered", fx.oracle("msg_leaf_b", UNORDERED))
def message_diff_unordered(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return md.compare_messages(a, b, ignore_order=True, ignore_attributes=True).select("msg_id", "diff_type", "path")


@GROUP.add("exact_path_map", fx.oracle(("cat_v1", "cat_v3"), "select a.path as source_path, b.path as target_path from cat_v1 a join cat_v3 b on a.path = b.path"))
def exact_path_map(spark, sf_dir):
    return mp.exact_path_map(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v3")).drop("how")


SIMILAR = """s as (select path, string_split(path, '/') as p from cat_v1 where path not in (select path from cat_v3)),
t as (select path, string_split(path, '/') as p from cat_v3),
best as (select s.path as source_path, t.path as target_path, len(list_filter(range(1, len(s.p) + 1), lambda i: s.p[i] = t.p[i])) as same
  from s join t on s.p[-1] = t.p[-1] and len(s.p) = len(t.p)),
sim as (select source_path, target_path from best where same >= 0.7 * len(string_split(source_path, '/')) qualify row_number() over (partition by source_path order by same desc, target_path) = 1)"""


@GROUP.add("similar_path_map", fx.oracle(("cat_v1", "cat_v3"), f"with {SIMILAR}\nselect * from sim"))
def similar_path_map(spark, sf_dir):
    return mp.similar_path_map(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v3")).drop("how")


@GROUP.add("build_mapping", fx.oracle(("cat_v1", "cat_v3"), f"""with {SIMILAR},
c as (select path as source_path, concat(path, '/Custom') as target_path from cat_v1 where k % 50 = 3)
select source_path, target_path, 'custom' as how from c
union all select source_path, target_path, 'similar' from sim where source_path not in (select source_path from c)
union all select a.path, a.path, 'exact' from cat_v1 a join cat_v3 b on a.path = b.path where a.path not in (select source_path from c)"""))
def build_mapping(spark, sf_dir):
    src = catalog(spark, sf_dir, "cat_v1")
    custom = src.filter("k % 50 = 3").select(F.col("path").alias("source_path"), F.concat("path", F.lit("/Custom")).alias("target_path"))
    return mp.build_mapping(src, catalog(spark, sf_dir, "cat_v3"), custom)


# ---- migration ---------------------------------------------------------------------

RENAMED = (("Document/CdtTrfTxInf/RmtInf/Ustrd", "Document/CdtTrfTxInf/RmtInf/Txt"),
           ("Document/CdtTrfTxInf/DbtrAgt/FinInstnId/BICFI", "Document/CdtTrfTxInf/DbtrAgt/FinInstnId/BIC"))


def _migration(spark, sf_dir):
    # field tables derived from all messages: small, read several times, so stored once
    target, source = checkpoint(fx.frame(spark, sf_dir, "msg_target")), checkpoint(fx.frame(spark, sf_dir, "msg_paths"))
    custom = spark.createDataFrame(list(RENAMED), "source_path string, target_path string")
    mapping = mp.exact_path_map(source, target).drop("how").unionByName(custom)
    return mp.move(messages(spark, sf_dir, damaged=False), mp.target_tree(mapping, target, now=NOW))


VALUES = f"""v as (select msg_id, path, arg_max(value, ord) as value from msg_leaf where ord <> 6 group by 1, 2),
ren as (select * from (values {', '.join(str(r) for r in RENAMED)}) x(s, t)),
mv as (select v.msg_id, coalesce(ren.t, v.path) as path, v.path as source_path, v.value from v left join ren on v.path = ren.s where coalesce(ren.t, v.path) in (select path from msg_target)),
chain as (select t.path, a.path as anc from msg_target t join msg_target a on (t.path = a.path or starts_with(t.path, concat(a.path, '/'))) where a.min_occurs = '0' and contains(a.path, '/')),
ex as (select m.msg_id, t.path from (select distinct msg_id from v) m cross join (select path from msg_target where contains(path, '/')) t
  where not exists (select 1 from chain c where c.path = t.path and not exists (select 1 from mv where mv.msg_id = m.msg_id and mv.path = c.anc))),
mig as (select ex.msg_id, ex.path, mv.source_path, coalesce(mv.value, case list_extract(string_split(ex.path, '/'), -1) when 'ChrgBr' then 'SLEV' when 'MsgId' then 'MSG20240115103000' when 'CreDtTm' then '2024-01-15T10:30:00' end) as value,
  case when mv.value is not null then 'mapped' when list_extract(string_split(ex.path, '/'), -1) in ('ChrgBr', 'MsgId', 'CreDtTm') then 'default' else 'empty' end as how from ex left join mv on ex.msg_id = mv.msg_id and ex.path = mv.path),
un as (select msg_id, path, value from v where path not in (select s from ren) and path not in (select path from msg_target))"""


def _m(body: str) -> str:
    return fx.oracle(("msg_leaf", "msg_target"), f"with {VALUES}\n{body}")


@GROUP.add("apply_mapping", _m("select msg_id, path as target_path, source_path, value from mv"))
def apply_mapping(spark, sf_dir):
    return mp.moved_values(_migration(spark, sf_dir))


@GROUP.add("unmapped_sources", _m("select * from un"))
def unmapped_sources(spark, sf_dir):
    return mp.moved_leftovers(_migration(spark, sf_dir))


@GROUP.add("migrate_messages", _m("select * from mig"))
def migrate_messages(spark, sf_dir):
    return mp.moved_rows(_migration(spark, sf_dir)).drop("depth")


ACTIONS = "select msg_id, how as action, source_path, path as target_path, value as target_value from mig where how <> 'empty' union all select msg_id, 'removed', path, '', null from un"


@GROUP.add("migration_actions", _m(ACTIONS))
def migration_actions(spark, sf_dir):
    moved = _migration(spark, sf_dir)
    return mp.actions(mp.moved_rows(moved), mp.moved_leftovers(moved))


@GROUP.add("transform_stats", _m(f"select msg_id, count(*) as total, count(*) filter (action = 'mapped') as mapped, count(*) filter (action = 'default') as defaults, count(*) filter (action = 'removed') as not_mapped from ({ACTIONS}) group by 1"))
def transform_stats(spark, sf_dir):
    return mp.moved_stats(_migration(spark, sf_dir))


@GROUP.add("migrated_roundtrip", _m("select msg_id, path, value from mig where value is not null"))
def migrated_roundtrip(spark, sf_dir):
    """Migrated messages written as XML and flattened again give the migrated values."""
    xml = mp.moved_messages(_migration(spark, sf_dir))
    return fl.leaves(fl.flatten_xml(xml, columns=("path", "kind", "value"))).select("msg_id", "path", "value")
