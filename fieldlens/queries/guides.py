"""Guides against each other and against the schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fieldlens import fixed, fixtures as fx
from fieldlens.operators import guides as gd
from fieldlens.queries.base import catalog
from fieldlens.registry import Group

GROUP = Group()


def _guide(spark, sf_dir, name):
    return fx.frame(spark, sf_dir, name).withColumn("pos", F.col("k"))


def _diff(spark, sf_dir):
    return gd.guide_diff(_guide(spark, sf_dir, "guide_a"), _guide(spark, sf_dir, "guide_b"), by=("message",))


def _diff_sql() -> str:
    label = "case %s when 'yellow' then 'Yellow/Core' when 'red' then 'Red/NotPermitted' else 'White/Optional' end"
    fields = []
    for c in fixed.RULE_COLUMNS:
        a, b = f"trim(a.{c}, ' ')", f"trim(b.{c}, ' ')"
        fields.append(f"case when {a} <> {b} then {{'field': '{c}', 'old': {a}, 'new': {b}}} end")
    sa, sb = label % "a.row_color", label % "b.row_color"
    fields.append(f"case when a.row_color <> b.row_color then {{'field': 'status', 'old': {sa}, 'new': {sb}}} end")
    side = ", ".join(f"{s}.{c} as {s}_{c}" for s in "ab" for c in ("tag", "type", "mult", "row_color"))
    return f"""q as (select coalesce(a.message, b.message) as message, coalesce(a.xpath, b.xpath) as xpath, a.xpath is not null as ia, b.xpath is not null as ib, {side},
  case when a.xpath is not null and b.xpath is not null then list_filter([{', '.join(fields)}], lambda x: x is not null) else [] end as ch
  from guide_a a full join guide_b b on a.xpath = b.xpath and a.message = b.message),
g as (select *, list_contains(list_transform(ch, lambda x: x.field), 'status') as st,
  case when not ia then 'ADDED' when not ib then 'REMOVED' when len(ch) = 0 then 'UNCHANGED'
    when list_contains(list_transform(ch, lambda x: x.field), 'status') and len(ch) > 1 then 'BOTH'
    when list_contains(list_transform(ch, lambda x: x.field), 'status') then 'STATUS' else 'RULES' end as change from q)"""


def _o(body: str) -> str:
    return fx.oracle("guide_b", f"with {_diff_sql()}\n{body}")


@GROUP.add("guide_diff_repeated", fx.oracle("guide_a", "select message, xpath, case when k % 5 = 0 then 'RULES' else 'UNCHANGED' end as change from guide_a"))
def guide_diff_repeated(spark, sf_dir):
    """Rows of an xpath repeated on both sides, in any order of the input: the last one of each side counts."""
    rows = _guide(spark, sf_dir, "guide_a")
    noise = rows.withColumn("mult", F.lit("9..9"))
    left = noise.withColumn("pos", F.lit(1)).unionByName(rows.withColumn("pos", F.lit(3))).unionByName(noise.withColumn("pos", F.lit(2)))
    later = rows.filter("k % 5 = 0").withColumn("mult", F.concat("mult", F.lit("x"))).withColumn("pos", F.lit(8))
    right = later.unionByName(rows.withColumn("pos", F.lit(7)))
    return gd.guide_diff(left, right, by=("message",)).select("message", "xpath", "change")


@GROUP.add("guide_diff", _o("select message, xpath, change, array_to_string(list_transform(ch, lambda x: x.field), ',') as changed_fields from g"))
def guide_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select(
        "message", "xpath", "change", F.array_join(F.transform("changed", lambda c: c["field"]), ",").alias("changed_fields"))


@GROUP.add("guide_what_changed", _o("""
select xpath, case when len(ch) = 0 then '—' else array_to_string(list_transform(ch, lambda x:
  concat(case x.field when 'mult' then 'Multiplicity' when 'length' then 'Length' when 'usage_rule' then 'Usage Rules' when 'rulebook' then 'Rulebook'
      when 'format_rule' then 'Format Rules' when 'code_restrictions' then 'Code Restrictions' else 'Status' end,
    case when x.old <> '' and x.new <> '' then concat(':', chr(10), '  A: ', left(x.old, 60), chr(10), '  B: ', left(x.new, 60))
      when x.new <> '' then concat(': (new) ', left(x.new, 60)) else ': (removed)' end)), chr(10)) end as what from g"""))
def guide_what_changed(spark, sf_dir):
    return _diff(spark, sf_dir).select("xpath", gd.what_changed().alias("what"))


def _pick(field: str, part: str) -> str:
    return f"list_filter(ch, lambda x: x.field = '{field}')[1].{part}"


def _impact_sql() -> str:
    o, n = (lambda f: _pick(f, "old")), (lambda f: _pick(f, "new"))
    so, sn = o("status"), n("status")
    return f"""array_to_string(list_filter([
  case when {so} is null then null when contains({so}, 'Core') and contains({sn}, 'Optional') then 'Status RELAXED: was Core Mandatory in EPC, is Optional in NPC. NPC implementations are not required to populate this field.'
    when contains({so}, 'Optional') and contains({sn}, 'Core') then 'Status ELEVATED: was Optional in EPC, is Core Mandatory in NPC. This field must be present in every NPC message.'
    when contains({sn}, 'NotPermitted') then 'Field BLOCKED in NPC: must NOT be included in NPC messages. EPC implementations that populate this field need a separate NPC code path.'
    when contains({so}, 'NotPermitted') and contains({sn}, 'Core') then 'Field UNBLOCKED in NPC: was Not Permitted in EPC, is now Core Mandatory. NPC must include this field.'
    when contains({so}, 'NotPermitted') then 'Field UNBLOCKED in NPC: was Not Permitted in EPC, is now Optional in NPC.'
    else concat('Status changed from ', {so}, ' (EPC) to ', {sn}, ' (NPC).') end,
  case when {o('length')} <> '' and {n('length')} <> '' then concat('Length constraint changed: EPC allows ', {o('length')}, ', NPC allows ', {n('length')}, '. Validate field values against the applicable limit per scheme.') end,
  case when {o('mult')} is not null then concat('Multiplicity changed: EPC ', {o('mult')}, ' → NPC ', {n('mult')}, '. Check cardinality handling in your implementation.') end,
  case when {o('usage_rule')} is not null then 'Usage rules differ between EPC and NPC. Review the rules in both columns and ensure your implementation satisfies the applicable scheme.' end,
  case when {o('format_rule')} is not null then 'Format rules differ. Review format constraints per scheme before implementing.' end
  ], lambda x: x is not null), ' ')"""


@GROUP.add("guide_impact", _o(f"""
select xpath, case change when 'UNCHANGED' then ''
  when 'ADDED' then concat('Field "', b_tag, '"', case when b_mult = '' then '' else concat(' (multiplicity ', b_mult, ')') end, ' is new in NPC and does not exist in EPC.',
    case b_row_color when 'yellow' then ' It is Core Mandatory — must be included in every NPC message.' when 'red' then ' It is blocked in NPC — do not include this field.' else ' It is optional in NPC.' end)
  when 'REMOVED' then concat('Field "', a_tag, '" exists in EPC but is not present in NPC.', case when a_row_color = 'yellow' then ' It was Core Mandatory in EPC.' else '' end, ' NPC processing can omit this field.')
  else {_impact_sql()} end as impact from g"""))
def guide_impact(spark, sf_dir):
    return _diff(spark, sf_dir).select("xpath", gd.guide_impact().alias("impact"))


@GROUP.add("guide_context", _o("""
select xpath, coalesce(case when a_mult <> b_mult then concat('A: ', a_mult, ' / B: ', b_mult) end, b_mult, a_mult) as mult, coalesce(b_tag, a_tag) as tag from g"""))
def guide_context(spark, sf_dir):
    return _diff(spark, sf_dir).select("xpath", gd.context_value("mult").alias("mult"), gd.context_value("tag").alias("tag"))


@GROUP.add("sheet_stats", _o("""
select coalesce(message, 'TOTAL') as message, %s, count(*) filter (change <> 'UNCHANGED') as changes from g group by rollup (message)""" % ", ".join(
    f"count(*) filter (change = '{c}') as {c.lower()}" for c in ("ADDED", "REMOVED", "STATUS", "RULES", "BOTH", "UNCHANGED"))))
def sheet_stats(spark, sf_dir):
    return gd.sheet_stats(_diff(spark, sf_dir))


@GROUP.add("guide_only_changes", _o("select xpath, change from g where change <> 'UNCHANGED'"))
def guide_only_changes(spark, sf_dir):
    from fieldlens.operators.schema_diff import only_changes

    return only_changes(_diff(spark, sf_dir), "change").select("xpath", "change")


@GROUP.add("pair_sheets", fx.oracle("guide_b", """
select coalesce(a.key, b.key) as key, a.s as sheet_a, b.s as sheet_b from
  (select lower(regexp_replace(message, '_([2-9])$', '')) as key, arg_min(message, p) as s from (select message, min(k) as p from guide_a group by 1) group by 1) a
  full join (select lower(regexp_replace(message, '_([2-9])$', '')) as key, arg_min(message, p) as s from (select message, min(k) as p from guide_b group by 1) group by 1) b on a.key = b.key"""))
def pair_sheets(spark, sf_dir):
    return gd.pair_sheets(_guide(spark, sf_dir, "guide_a"), _guide(spark, sf_dir, "guide_b"))


@GROUP.add("attach_labels", fx.oracle("guide_b", """
select s.message as sheet, coalesce(b.mid, replace(s.message, '_', '.')) as message_id, coalesce(b.lbl, s.message) as label
from (select distinct message from guide_a) s left join (select message, upper(message) as mid, concat('Use of ', message) as lbl from guide_b where k % 4 <> 3 group by 1) b on s.message = b.message"""))
def attach_labels(spark, sf_dir):
    sheets = gd.sheet_list(_guide(spark, sf_dir, "guide_a")).select(F.col("message").alias("sheet"))
    summary = gd.sheet_list(_guide(spark, sf_dir, "guide_b").filter("k % 4 <> 3")).select(
        F.col("message").alias("sheet"), F.upper("message").alias("message_id"), F.concat(F.lit("Use of "), "message").alias("label"))
    return gd.attach_labels(sheets, summary)


@GROUP.add("resolve_sheet", fx.oracle("guide_a", """
select r as requested, case r when '' then (select arg_min(message, k) from guide_a) when 'msg_1' then 'msg_1' when 'MSG_3' then 'msg_3' when 'sg' then (select arg_min(message, k) from guide_a) end as sheet,
  case when r = 'none' then (select string_agg(distinct message, ', ' order by message) from guide_a) else '' end as available
from (select unnest(['msg_1', 'MSG_3', 'sg', '', 'none']) as r)"""))
def resolve_sheet(spark, sf_dir):
    guide = _guide(spark, sf_dir, "guide_a")
    return reduce(lambda x, y: x.unionByName(y), [gd.resolve_sheet(guide, n) for n in ("msg_1", "MSG_3", "sg", "", "none")])


@GROUP.add("distinct_messages", fx.oracle("guide_b", "select message, min(k) as first_pos from guide_b group by message"))
def distinct_messages(spark, sf_dir):
    return gd.distinct_messages(_guide(spark, sf_dir, "guide_b"))


GUIDE_STATUS = """case when row_color = 'yellow' then 'Mandatory' when row_color = 'red' then 'Not Permitted' when split_part(mult, '..', 1) = '1' then 'Mandatory'
  when starts_with(lower(trim(usage_rule)), 'mandatory') then 'Conditional' else 'Optional' end"""
GUIDE_SOURCE = """case when row_color = 'yellow' then 'explicit (cell colour: Yellow)' when row_color = 'red' then 'explicit (cell colour: Red)' when split_part(mult, '..', 1) = '1' then concat('derived (Multiplicity=', mult, ')')
  when starts_with(lower(trim(usage_rule)), 'mandatory') then 'derived (Usage Rule starts with "Mandatory")' else concat('derived (Multiplicity=', mult, ', no colour)') end"""


@GROUP.add("guide_status", fx.oracle("guide_b", f"select xpath, message, {GUIDE_STATUS} as status, {GUIDE_SOURCE} as status_source from guide_b"))
def guide_status(spark, sf_dir):
    return gd.with_guide_status(_guide(spark, sf_dir, "guide_b")).select("xpath", "message", "status", "status_source")


@GROUP.add("has_colour", fx.oracle("guide_b", """
select message, bool_or(row_color in ('yellow', 'red')) as has_colour from guide_b group by 1"""))
def has_colour(spark, sf_dir):
    return gd.has_colour(_guide(spark, sf_dir, "guide_b"))


@GROUP.add("filter_status", fx.oracle("guide_a", f"""
select 'mandatory' as mode, xpath from guide_a where ({GUIDE_STATUS}) = 'Mandatory' union all select 'exclude_notperm', xpath from guide_a where ({GUIDE_STATUS}) <> 'Not Permitted'"""))
def filter_status(spark, sf_dir):
    guide = gd.with_guide_status(_guide(spark, sf_dir, "guide_a"))
    one = lambda m: gd.filter_status(guide, m).select(F.lit(m).alias("mode"), "xpath")
    return one("mandatory").unionByName(one("exclude_notperm"))


@GROUP.add("match_messages", fx.oracle("guide_a", "select xpath, message from guide_a where contains(lower(message), 'g_1') or contains(lower(message), 'msg_2')"))
def match_messages(spark, sf_dir):
    return gd.match_messages(_guide(spark, sf_dir, "guide_a"), ["G_1", "msg_2"]).select("xpath", "message")


@GROUP.add("match_keys", fx.oracle("guide_a", "select xpath, idx from guide_a where idx in ('1.5', '1.77', '1.150')"))
def match_keys(spark, sf_dir):
    return gd.match_keys(_guide(spark, sf_dir, "guide_a"), ["1.5", "1.77", "1.150"], "idx").select("xpath", "idx")


@GROUP.add("schema_status", fx.oracle("cat_v1", """
select path, case when field_class = 'RED' then 'Not Permitted' when field_class = 'YELLOW' and min_occurs = '0' then 'Conditional' when field_class = 'YELLOW' then 'Mandatory'
   when field_class = 'WHITE' then 'Optional' when min_occurs = '1' then 'Mandatory' else 'Optional' end as status,
  case when field_class = 'YELLOW' and min_occurs = '0' then concat('explicit (Yellow annotation, minOccurs=0..', max_occurs, ')') when field_class = 'YELLOW' then concat('explicit (Yellow annotation, minOccurs=', min_occurs, ')')
   when field_class = 'WHITE' then 'explicit (White annotation)' when min_occurs = '1' then 'derived (minOccurs=1, no colour annotation)' else concat('derived (minOccurs=', min_occurs, ', no colour annotation)') end as status_source from cat_v1"""))
def schema_status(spark, sf_dir):
    return gd.with_schema_status(catalog(spark, sf_dir, "cat_v1")).select("path", "status", "status_source")


def _xref(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_v2").withColumn("length_text", F.col("restrictions"))
    # chunks far smaller than the data, so that the carry between chunks is exercised
    return gd.cross_reference(cat, _guide(spark, sf_dir, "guide_b"))


_NR = "trim(regexp_replace(lower(%s), '\\s+', ' ', 'g'))"
XREF = f"""xs as (select tag, path as x_path, concat(min_occurs, '..', max_occurs) as x_mult, usage_rules as x_usage, restrictions as x_length,
  case when field_class = 'YELLOW' and min_occurs = '0' then 'Conditional' when field_class = 'YELLOW' then 'Mandatory' when field_class = 'WHITE' then 'Optional' when min_occurs = '1' then 'Mandatory' else 'Optional' end as x_status,
  case when field_class = 'YELLOW' and min_occurs = '0' then concat('explicit (Yellow annotation, minOccurs=0..', max_occurs, ')') when field_class = 'YELLOW' then concat('explicit (Yellow annotation, minOccurs=', min_occurs, ')')
   when field_class = 'WHITE' then 'explicit (White annotation)' when min_occurs = '1' then 'derived (minOccurs=1, no colour annotation)' else concat('derived (minOccurs=', min_occurs, ', no colour annotation)') end as x_source,
  row_number() over (partition by tag order by seq, path) as rn from cat_v2),
gs as (select tag, xpath as g_path, idx, mult as g_mult, usage_rule as g_usage, format_rule as g_format, length as g_length, {GUIDE_STATUS} as g_status, {GUIDE_SOURCE} as g_source,
  row_number() over (partition by tag order by k, xpath) as rn from guide_b),
j as (select coalesce(xs.tag, gs.tag) as tag, coalesce(xs.rn, gs.rn) as rn, xs.* exclude (tag, rn), gs.* exclude (tag, rn) from xs full join gs on xs.tag = gs.tag and xs.rn = gs.rn),
f as (select *, (x_status = 'Mandatory' and g_status <> 'Mandatory') or (x_status = 'Optional' and g_status = 'Mandatory')
    or (x_status = 'Conditional' and g_status = 'Mandatory' and g_source <> 'explicit (cell colour: Yellow)') as sd,
  {_NR % 'x_usage'} <> {_NR % 'g_usage'} or g_format <> '' or {_NR % 'x_length'} <> {_NR % 'g_length'} as rd,
  replace(x_mult, 'unbounded', 'n') <> replace(g_mult, 'unbounded', 'n') as md from j),
r as (select *, case when g_path is null then 'XSD_ONLY' when x_path is null then 'EXCLUDED' when sd and rd then 'BOTH_DIFF' when sd then 'STATUS_DIFF' when rd then 'RULES_DIFF' when md then 'MULT_DIFF' else 'ALIGNED' end as gap from f)"""


def _x(body: str) -> str:
    return fx.oracle(("cat_v2", "guide_b"), f"with {XREF}\n{body}")


@GROUP.add("pair_by_tag_position", _x("select tag, rn, x_path, g_path from r"))
def pair_by_tag_position(spark, sf_dir):
    return _xref(spark, sf_dir).select("tag", "rn", "x_path", "g_path")


@GROUP.add("cross_reference", _x("select tag, rn, x_path, g_path, x_status, g_status, gap from r"))
def cross_reference(spark, sf_dir):
    return _xref(spark, sf_dir).select("tag", "rn", "x_path", "g_path", "x_status", "g_status", "gap")


@GROUP.add("rules_and_mult_differ", _x("select tag, rn, coalesce(rd, false) as rules_differ, coalesce(md, false) as mult_differs from r where g_path is not null and x_path is not null"))
def rules_and_mult_differ(spark, sf_dir):
    from fieldlens.functions import text as t

    rows = _xref(spark, sf_dir).filter("x_path is not null and g_path is not null")
    rules = t.rules_differ("x_usage", "g_usage") | t.rules_differ("x_format", "g_format") | t.rules_differ("x_length", "g_length")
    return rows.select("tag", "rn", rules.alias("rules_differ"), t.mult_differs("x_mult", "g_mult").alias("mult_differs"))


@GROUP.add("gap_findings", _x(f"""
select tag, rn, gap, case gap when 'ALIGNED' then '' when 'EXCLUDED' then concat('Field exists in the guide (index ', idx, ') but is absent from the schema — the scheme does not permit this field.')
  when 'XSD_ONLY' then 'Field defined in the schema but not found in the guide — may be a sub-element or new constraint not yet documented.'
  else coalesce(nullif(array_to_string(list_filter([
    case when x_status <> g_status and x_status = 'Conditional' then concat('XSD marks as Conditional (Yellow, ', x_mult, ') — mandatory when condition is met. IG shows "', g_status, '" [', g_source, '].')
      when x_status <> g_status then concat('Status: XSD says "', x_status, '" [', x_source, ']. IG says "', g_status, '" [', g_source, '].') end,
    case when md then concat('Multiplicity: XSD=', x_mult, ', IG=', g_mult, '.') end,
    case when {_NR % 'x_length'} <> {_NR % 'g_length'} then concat('Length: XSD="', x_length, '", IG="', g_length, '".') end,
    case when {_NR % 'x_usage'} <> '' and {_NR % 'g_usage'} = '' then 'Usage rule in XSD annotation not present in IG.' when {_NR % 'x_usage'} = '' and {_NR % 'g_usage'} <> '' then 'Usage rule in IG not captured in XSD annotation.'
      when {_NR % 'x_usage'} <> {_NR % 'g_usage'} then 'Usage rules differ between XSD and IG — review both.' end,
    case when g_format <> '' then 'Format rules differ.' end], lambda x: x is not null), ' '), ''), 'Difference detected — review both columns.') end as finding from r"""))
def gap_findings(spark, sf_dir):
    return _xref(spark, sf_dir).select("tag", "rn", "gap", "finding")


@GROUP.add("gap_stats", _x("select gap, count(*) as n, printf('%.1f%%', floor(count(*) * 100.0::double / sum(count(*)) over () * 10 + 0.5) / 10) as percent from r group by gap union all select 'TOTAL', count(*), '' from r"))
def gap_stats(spark, sf_dir):
    return gd.gap_stats(_xref(spark, sf_dir)).filter("n > 0").select("gap", "n", "percent")


@GROUP.add("gap_percent", _x("select gap, n, floor(n * 1000.0::double / sum(n) over () + 0.5) / 10 as percent, cast(floor(n * 200.0::double / max(n) over () + 0.5) as bigint) as bar_width from (select gap, count(*) as n from r group by gap)"))
def gap_percent(spark, sf_dir):
    return gd.gap_percent(_xref(spark, sf_dir))


@GROUP.add("gap_views", _x("""
select 'excluded' as view, tag, rn from r where gap = 'EXCLUDED' union all select 'schema_only', tag, rn from r where gap = 'XSD_ONLY'
union all select 'gaps', tag, rn from r where gap <> 'ALIGNED'
union all select 'mandatory', tag, rn from r where x_status in ('Mandatory', 'Conditional') or g_status in ('Mandatory', 'Conditional')
union all select 'conditional', tag, rn from r where x_status = 'Conditional'"""))
def gap_views(spark, sf_dir):
    from fieldlens.operators.schema_diff import only_changes

    rows = _xref(spark, sf_dir)
    views = {"excluded": gd.by_gap(rows, "EXCLUDED"), "schema_only": gd.by_gap(rows, "XSD_ONLY"), "gaps": only_changes(rows, "gap"),
             "mandatory": gd.mandatory_checklist(rows), "conditional": gd.conditional_fields(rows)}
    return reduce(lambda x, y: x.unionByName(y), [v.select(F.lit(n).alias("view"), "tag", "rn") for n, v in views.items()])


COLOUR = "case row_color when 'yellow' then 'Mandatory' when 'red' then 'Not Permitted' else 'Optional' end"


@GROUP.add("status_stats", fx.oracle("guide_b", f"""
select coalesce(message, 'TOTAL') as message, total, mandatory, optional, not_permitted, printf('%.0f%%', floor(mandatory * 100.0::double / total + 0.5)) as percent,
  case when message is null then '' when mandatory > 50 then 'High priority' when mandatory > 10 then 'Medium priority' else 'Lower priority' end as priority
from (select message, count(*) as total, count(*) filter (s = 'Mandatory') as mandatory, count(*) filter (s = 'Optional') as optional, count(*) filter (s = 'Not Permitted') as not_permitted
  from (select message, {COLOUR} as s from guide_b) group by rollup (message))"""))
def status_stats(spark, sf_dir):
    return gd.status_stats(_guide(spark, sf_dir, "guide_b").withColumn("status", gd.colour_status()))


@GROUP.add("guide_enrich", fx.oracle(("cat_v1", "guide_b"), """
select g.xpath, coalesce(x.enums, '') as schema_codes, coalesce(nullif(x.restrictions, ''), g.length) as effective_length, x.path is not null as enriched
from (select *, row_number() over (partition by tag order by k, xpath) as rn from guide_b) g
left join (select *, row_number() over (partition by tag order by seq, path) as rn from cat_v1) x on g.tag = x.tag and g.rn = x.rn"""))
def guide_enrich(spark, sf_dir):
    facets = fx.frame(spark, sf_dir, "cat_v1").select("tag", "seq", "path", F.lit("").alias("pattern"), "enums", F.col("restrictions").alias("length_text"))
    return gd.guide_enrich(_guide(spark, sf_dir, "guide_b"), facets).select("xpath", "schema_codes", "effective_length", "enriched")


@GROUP.add("guide_template", fx.oracle("guide_a", f"""
select xpath, tag, s as status, case when type = 'ISODate' then '2024-01-15' when type = 'Amount' then '1000.00' else 'SAMPLE20' end as transformation,
  '' as source_system, '' as default_hint, case when s = 'Not Permitted' then 'N/A' else 'TODO' end as work_status from (select *, {COLOUR} as s from guide_a)"""))
def guide_template(spark, sf_dir):
    return gd.guide_template(_guide(spark, sf_dir, "guide_a")).select(
        "xpath", "tag", "status", "transformation", "source_system", "default_hint", "work_status")
