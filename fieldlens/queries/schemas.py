"""Two versions of a schema: differences, views and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixed, fixtures as fx
from fieldlens.operators import schema_diff as sd
from fieldlens.queries.base import catalog
from fieldlens.registry import Group

GROUP = Group()


def _diff(spark, sf_dir):
    facets = fx.frame(spark, sf_dir, "type_facets")
    return sd.schema_diff(
        catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2"), right_name="v2",
        facets_a=facets.filter("schema_id = 'v1'"), facets_b=facets.filter("schema_id = 'v2'"))


def _class_case(part: int, a: str, b: str) -> str:
    whens = " ".join(f"when {a} = '{r[0]}' and {b} = '{r[1]}' then '{r[part]}'" for r in fixed.CLASS_TRANSITIONS)
    return f"case {whens} else '{fixed.CLASS_OTHER[part - 2]}' end"


def diff_rows(left: str, right: str, name: str, by: str = "", on: str = "", facets: bool = True) -> str:
    """Oracle text of the change rows between two catalog relations."""
    none = lambda c: f"case when {c} = '' then 'None' else {c} end"
    cut = lambda c: none(f"case when length({c}) > 100 then concat(left({c}, 100), '...') else {c} end")
    lst = lambda c: f"case when {c} = '' then 'None' else replace({c}, ',', ', ') end"
    by_cols = f"{by}, " if by else ""
    arms = [
        f"select {by_cols}path, btag as element, 0 as sl, bseq as sr, '' as lt, btype as rt, 'ADDED' as change_type, 'HIGH' as severity, 'NOT PRESENT' as old_value, 'PRESENT' as new_value, concat('New field ''', path, ''' added in {name}. May be required in new version.') as impact from p where atag is null",
        f"select {by_cols}path, atag, aseq, 0, atype, '', 'REMOVED', 'HIGH', 'PRESENT', 'NOT PRESENT', concat('Field ''', path, ''' removed in {name}. Breaking change if field was in use.') from p where btag is null",
    ]

    def arm(cond, kind, sev, old, new, impact):
        arms.append(f"select {by_cols}path, atag, aseq, bseq, atype, btype, '{kind}', {sev}, {old}, {new}, {impact} from b where {cond}")

    facet = "coalesce(concat(' Restrictions: ', fd), '')" if facets else "''"
    arm("atype <> btype", "TYPE_CHANGED", "'HIGH'", "atype", "btype",
        f"concat('Data type changed from ''', atype, ''' to ''', btype, '''. May require data conversion.', {facet})")
    arm("amin <> bmin", "CARDINALITY_CHANGED", "case when amin = '0' and bmin <> '0' then 'HIGH' else 'MEDIUM' end",
        "concat('min:', amin)", "concat('min:', bmin)",
        "case when bmin <> '0' then 'Field is now required.' else 'Field is now optional.' end")
    arm("amax <> bmax", "CARDINALITY_CHANGED", "'MEDIUM'", "concat('max:', amax)", "concat('max:', bmax)",
        "concat('Max occurrences changed from ', amax, ' to ', bmax, '.')")
    arm("ares <> bres", "RESTRICTION_CHANGED", "'HIGH'", none("ares"), none("bres"), "'Validation rules changed. May affect data validation.'")
    arm("acls <> bcls", "FIELD_CLASS_CHANGED", _class_case(2, "acls", "bcls"), "acls", "bcls", _class_case(4, "acls", "bcls"))
    arm("afix <> bfix", "FIXED_VALUE_CHANGED", "'HIGH'", none("afix"), none("bfix"),
        f"concat('Fixed value changed from ''', {none('afix')}, ''' to ''', {none('bfix')}, '''. Messages must use new fixed value.')")
    arm("adef <> bdef", "DEFAULT_VALUE_CHANGED", "'MEDIUM'", none("adef"), none("bdef"),
        f"concat('Default value changed from ''', {none('adef')}, ''' to ''', {none('bdef')}, '''.')")
    arm("arb <> brb", "RULEBOOK_CHANGED", "case when brb = '' then 'LOW' else 'MEDIUM' end", cut("arb"), cut("brb"),
        "case when brb = '' then 'Rulebook note removed.' when arb = '' then concat('New Rulebook note added: ', left(brb, 100), '...') else 'Rulebook note changed. Review business requirements.' end")
    arm("aur <> bur", "USAGE_RULES_CHANGED", "case when bur = '' then 'LOW' else 'MEDIUM' end", cut("aur"), cut("bur"),
        "case when bur = '' then 'Usage rules removed.' when aur = '' then 'New usage rules added.' else 'Usage rules changed. Review implementation requirements.' end")
    gone = "list_sort(list_filter(case when aen = '' then [] else string_split(aen, ',') end, lambda x: not list_contains(string_split(ben, ','), x)))"
    came = "list_sort(list_filter(case when ben = '' then [] else string_split(ben, ',') end, lambda x: not list_contains(string_split(aen, ','), x)))"
    arm("aen <> ben", "ENUMERATION_CHANGED", f"case when len({gone}) > 0 then 'HIGH' when len({came}) > 0 then 'MEDIUM' else 'LOW' end",
        lst("aen"), lst("ben"),
        f"case when len({gone}) > 0 then concat('Enumeration values removed: ', array_to_string({gone}, ', '), '. Breaking change for existing data.') when len({came}) > 0 then concat('Enumeration values added: ', array_to_string({came}, ', '), '. New values available.') else 'Enumeration values changed.' end")
    cols = lambda s: ", ".join(f"{s}.{c} as {s}{d}" for c, d in (
        ("tag", "tag"), ("seq", "seq"), ("type", "type"), ("min_occurs", "min"), ("max_occurs", "max"),
        ("restrictions", "res"), ("field_class", "cls"), ("fixed", "fix"), ("dflt", "def"), ("rulebook", "rb"),
        ("usage_rules", "ur"), ("enums", "en")))
    key = f"coalesce(a.{by}, b.{by}) as {by}, " if by else ""
    fd = """, (select string_agg(concat(coalesce(x.facet, y.facet), ': ', coalesce(x.value, 'N/A'), ' → ', coalesce(y.value, 'N/A')), '; ' order by coalesce(x.facet, y.facet))
        from (select * from type_facets where schema_id = 'v1' and type_name = p.atype) x
        full join (select * from type_facets where schema_id = 'v2' and type_name = p.btype) y on x.facet = y.facet
        where x.value is distinct from y.value) as fd""" if facets else ""
    if facets:
        fd_cte = """fds as (
  select tt.atype, tt.btype, string_agg(concat(f, ': ', coalesce(x.value, 'N/A'), ' → ', coalesce(y.value, 'N/A')), '; ' order by f) as fd
  from (select distinct atype, btype from p where atype <> btype) tt
  cross join (select distinct facet as f from type_facets) ff
  left join type_facets x on x.schema_id = 'v1' and x.type_name = tt.atype and x.facet = f
  left join type_facets y on y.schema_id = 'v2' and y.type_name = tt.btype and y.facet = f
  where x.value is distinct from y.value group by 1, 2),
b as (select p.*, fds.fd from p left join fds on p.atype = fds.atype and p.btype = fds.btype where atag is not null and btag is not null),"""
    else:
        fd_cte = "b as (select * from p where atag is not null and btag is not null),"
    del fd
    return (f"p as (select {key}coalesce(a.path, b.path) as path, {cols('a')}, {cols('b')} from {left} a full join {right} b on a.path = b.path{on}),\n"
            + fd_cte + "\nd as (" + "\nunion all ".join(arms) + ")")


DIFF = diff_rows("cat_v1", "cat_v2", "v2")
NEEDS = ("cat_v1", "cat_v2", "type_facets")


def _o(body: str) -> str:
    return fx.oracle(NEEDS, f"with {DIFF}\n{body}")


@GROUP.add("pair_by_path", fx.oracle(("cat_v1", "cat_v2"), """
select coalesce(a.path, b.path) as path, a.path is not null as in_a, b.path is not null as in_b, a.type as a_type, b.type as b_type
from cat_v1 a full join cat_v2 b on a.path = b.path"""))
def pair_by_path(spark, sf_dir):
    return sd.pair_by_path(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2"), fields=("type",))


@GROUP.add("schema_diff", _o("select path, element, sl as seq_left, sr as seq_right, lt as left_type, rt as right_type, change_type, severity, old_value, new_value, impact from d"))
def schema_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select(
        "path", "element", "seq_left", "seq_right", "left_type", "right_type",
        "change_type", "severity", "old_value", "new_value", "impact")


def _one_type(names):
    quoted = ", ".join(f"'{n}'" for n in names)
    return _o(f"select path, change_type, severity, old_value, new_value, impact from d where change_type in ({quoted})")


def _of_types(names):
    def run(spark, sf_dir):
        return _diff(spark, sf_dir).filter(F.col("change_type").isin(*names)).select(
            "path", "change_type", "severity", "old_value", "new_value", "impact")

    return run


for _name, _types in (
    ("diff_presence", ("ADDED", "REMOVED")), ("diff_type", ("TYPE_CHANGED",)),
    ("diff_cardinality", ("CARDINALITY_CHANGED",)), ("diff_restrictions", ("RESTRICTION_CHANGED",)),
    ("diff_fixed_default", ("FIXED_VALUE_CHANGED", "DEFAULT_VALUE_CHANGED")),
    ("diff_rulebook_usage", ("RULEBOOK_CHANGED", "USAGE_RULES_CHANGED")),
):
    GROUP.add(_name, _one_type(_types))(_of_types(_types))


@GROUP.add("diff_field_class", _o(f"select severity, element, path, old_value, new_value, {_class_case(3, 'old_value', 'new_value')} as direction, impact from d where change_type = 'FIELD_CLASS_CHANGED'"))
def diff_field_class(spark, sf_dir):
    return sd.class_changes(_diff(spark, sf_dir))


@GROUP.add("diff_enums", _o("""
select severity, element, path, old_value, new_value,
  coalesce(nullif(array_to_string(list_sort(list_filter(case when new_value = 'None' then [] else string_split(new_value, ', ') end, lambda x: not list_contains(string_split(old_value, ', '), x))), ', '), ''), 'None') as added,
  coalesce(nullif(array_to_string(list_sort(list_filter(case when old_value = 'None' then [] else string_split(old_value, ', ') end, lambda x: not list_contains(string_split(new_value, ', '), x))), ', '), ''), 'None') as removed,
  impact from d where change_type = 'ENUMERATION_CHANGED'"""))
def diff_enums(spark, sf_dir):
    return sd.enum_changes(_diff(spark, sf_dir))


@GROUP.add("facet_change_rows", fx.oracle(NEEDS, """
select a.path, a.tag as element, a.type as left_type, b.type as right_type, f as restriction,
  coalesce(x.value, 'N/A') as old_value, coalesce(y.value, 'N/A') as new_value
from cat_v1 a join cat_v2 b on a.path = b.path and a.type <> b.type
cross join (select distinct facet as f from type_facets) ff
left join type_facets x on x.schema_id = 'v1' and x.type_name = a.type and x.facet = f
left join type_facets y on y.schema_id = 'v2' and y.type_name = b.type and y.facet = f
where x.value is distinct from y.value"""))
def facet_change_rows(spark, sf_dir):
    return sd.facet_change_rows(_diff(spark, sf_dir))


_SIDE = """
select coalesce(a.path, b.path) as path, coalesce(a.tag, b.tag) as element,
  coalesce(a.type, '') as a_type, coalesce(a.min_occurs, '') as a_min_occurs, coalesce(a.max_occurs, '') as a_max_occurs,
  coalesce(b.type, '') as b_type, coalesce(b.min_occurs, '') as b_min_occurs, coalesce(b.max_occurs, '') as b_max_occurs,
  case when b.path is null then 'REMOVED' when a.path is null then 'ADDED'
    when a.type <> b.type or a.min_occurs <> b.min_occurs or a.max_occurs <> b.max_occurs then 'CHANGED' else 'SAME' end as status
from cat_v1 a full join cat_v2 b on a.path = b.path"""


@GROUP.add("side_by_side", fx.oracle(("cat_v1", "cat_v2"), _SIDE))
def side_by_side(spark, sf_dir):
    rows = sd.side_by_side(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2"))
    return sd.order_paths(rows, "a_seq", "b_seq").drop("a_seq", "b_seq")


@GROUP.add("only_changes", fx.oracle(("cat_v1", "cat_v2"), f"select path, status from ({_SIDE}) where status <> 'SAME'"))
def only_changes(spark, sf_dir):
    rows = sd.side_by_side(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2"))
    return sd.only_changes(rows).select("path", "status")


@GROUP.add("change_examples", _o("""
select path, change_type,
  case change_type when 'REMOVED' then concat('<', tag, '>sample_value</', tag, '>') when 'ADDED' then concat('<!-- ', tag, ' did not exist -->')
    else concat('<', tag, '><!-- ', left(lt, 30), ' --></', tag, '>') end as before,
  case change_type when 'REMOVED' then concat('<!-- ', tag, ' removed -->') when 'ADDED' then concat('<', tag, '>new_value</', tag, '>')
    else concat('<', tag, '><!-- ', left(rt, 30), ' --></', tag, '>') end as after
from (select *, list_extract(string_split(path, '/'), -1) as tag from d) where change_type in ('ADDED', 'REMOVED', 'TYPE_CHANGED')"""))
def change_examples(spark, sf_dir):
    return sd.change_examples(_diff(spark, sf_dir))


@GROUP.add("search_changes", _o("""
select path, change_type, severity, old_value, new_value from d
where severity = 'HIGH' and contains(lower(concat_ws(' ', path, element, change_type, severity, old_value, new_value, impact)), 'text')"""))
def search_changes(spark, sf_dir):
    rows = sd.search(_diff(spark, sf_dir), "Text", "HIGH",
                     ("path", "element", "change_type", "severity", "old_value", "new_value", "impact"))
    return rows.select("path", "change_type", "severity", "old_value", "new_value")


@GROUP.add("severity_kind_split", _o("""
select severity, case when change_type in ('ADDED', 'REMOVED') then change_type else 'MODIFIED' end as kind, count(*) as n from d group by 1, 2"""))
def severity_kind_split(spark, sf_dir):
    kind = F.when(F.col("change_type").isin("ADDED", "REMOVED"), F.col("change_type")).otherwise("MODIFIED")
    return _diff(spark, sf_dir).groupBy("severity", kind.alias("kind")).agg(F.count("*").alias("n"))


@GROUP.add("diff_stats", _o("""
select t as change_type, case when t = 'TOTAL' then (select count(*) from d) else count(d.path) end as n
from (select unnest(['TOTAL', %s]) as t) left join d on d.change_type = t group by t""" % ", ".join(f"'{c}'" for c in fixed.CHANGE_TYPES)))
def diff_stats(spark, sf_dir):
    return sd.diff_stats(_diff(spark, sf_dir))


@GROUP.add("severity_stats", _o("""
select s as severity, count(d.path) as n from (select unnest(['HIGH', 'MEDIUM', 'LOW']) as s) left join d on d.severity = s group by s"""))
def severity_stats(spark, sf_dir):
    return sd.severity_stats(_diff(spark, sf_dir))


@GROUP.add("changes_by_type", _o("""
select change_type, count(*) as n, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium,
  count(*) filter (severity = 'LOW') as low,
  concat(array_to_string(list(element order by rn) filter (rn <= 5), ', '), case when count(*) > 5 then concat(' (+', count(*) - 5, ' more)') else '' end) as samples
from (select *, row_number() over (partition by change_type order by path, old_value) as rn from d) group by change_type"""))
def changes_by_type(spark, sf_dir):
    return sd.changes_by_type(_diff(spark, sf_dir))


@GROUP.add("directional_counts", _o("""
select direction, count(*) as n, array_to_string(list(path order by path) filter (rn <= 10), ', ') as paths
from (select *, row_number() over (partition by direction order by path) as rn from (
  select *, case when old_value = 'WHITE' and new_value = 'YELLOW' then 'upgraded' when old_value = 'YELLOW' and new_value = 'WHITE' then 'downgraded'
    when old_value = 'NA' and new_value = 'YELLOW' then 'newly_mandatory' end as direction from d where change_type = 'FIELD_CLASS_CHANGED') where direction is not null)
group by direction"""))
def directional_counts(spark, sf_dir):
    return sd.directional_counts(_diff(spark, sf_dir))


@GROUP.add("order_by_count_desc", _o("select change_type, n, row_number() over (order by n desc, change_type) as position from (select change_type, count(*) as n from d group by 1)"))
def order_by_count_desc(spark, sf_dir):
    # at most one row per change type reaches this window
    from pyspark.sql import Window as W

    counts = _diff(spark, sf_dir).groupBy("change_type").agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.row_number().over(W.orderBy(F.desc("n"), "change_type")))


@GROUP.add("order_by_severity", _o("select path, change_type, severity, old_value from d"))
def order_by_severity(spark, sf_dir):
    return sd.order_by_severity(_diff(spark, sf_dir)).select("path", "change_type", "severity", "old_value")


@GROUP.add("order_detail", _o("select path, change_type, severity, sl as seq_left, sr as seq_right from d"))
def order_detail(spark, sf_dir):
    return sd.order_detail(_diff(spark, sf_dir)).select("path", "change_type", "severity", "seq_left", "seq_right")


@GROUP.add("order_by_depth", fx.oracle("cat_v1", "select path, length(path) as path_length from cat_v1"))
def order_by_depth(spark, sf_dir):
    return sd.order_by_depth(catalog(spark, sf_dir, "cat_v1")).select("path", F.length("path").alias("path_length"))
