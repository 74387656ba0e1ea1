"""Records, change logs, sections and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixed, fixtures as fx
from fieldlens.operators import ordered, pages as pg, records as rc
from fieldlens.queries.base import catalog
from fieldlens.registry import Group

GROUP = Group()
# Chunks far smaller than production ones, so that carries between chunks take part in every check.


@GROUP.add("group_records", fx.oracle("conv_rows", """
select conv_id, rec, min(row_no) as first_row, count(*) as n_rows, md5(string_agg(text, chr(10) order by row_no)) as digest
from (select *, sum(case when is_start then 1 else 0 end) over (partition by conv_id order by row_no) as rec from conv_rows) where rec > 0 group by 1, 2"""))
def group_records(spark, sf_dir):
    rows = fx.frame(spark, sf_dir, "conv_rows")
    return rc.group_records(rows, ["conv_id"], "row_no", F.col("is_start"), "text").withColumn("digest", F.md5("text")).drop("text")


GUIDE = """r as (select doc_id, rec_key, bool_or(line = 7) as ch, max(line) as n,
  max(case when line = 1 then c0 end) as idx, max(case when line = 1 then split_part(c3, ' ', 3) end) as tag, max(case when line = 2 then split_part(c3, '.. ', 2) end) as len,
  max(case when line = 3 then concat('Mandatory for ', split_part(c3, 'for ', 2)) end) as rule, bool_or(line = 4) as cont, max(case when line = 5 then split_part(c3, ' ', 3) end) as nm, bool_or(line = 6) as rb,
  bool_or(line < 7 and colour = 'red') as red, bool_or(line < 7 and colour = 'yellow') as yel, max(case when line = 7 then colour end) as ccol
  from guide_cells group by 1, 2),
g as (select doc_id, rec_key * 2 as k, idx, '0..1' as mult, case when n >= 6 then 'Root Message/Credit Transfer/Amount' when n = 5 then 'Root Message/Credit Transfer' when n = 4 then 'Root Message/Group Header/Settlement Information'
    when n = 3 then 'Root Message/Group Header/Settlement' when n = 2 then 'Root Message/Group Header' else 'Root Message' end as xpath, tag, 'Max35Text' as type, coalesce(nm, '') as iso_name,
  case when len is null then '' else concat('1 .. ', len) end as length, case when rule is null then '' when cont then concat(rule, ' continued text') else rule end as usage_rule,
  case when rb then 'AT-01' else '' end as rulebook, case when red then 'red' when yel then 'yellow' else 'white' end as row_color, false as is_choice from r
 union all select doc_id, rec_key * 2 + 1, '', '0..1', 'Code', 'xs:choice', '', '', '', '', '', ccol, true from r where ch)"""


def _guide_records(spark, sf_dir):
    return rc.guide_records(fx.frame(spark, sf_dir, "guide_cells"))


def _g(body: str) -> str:
    return fx.oracle("guide_cells", f"with {GUIDE}\n{body}")


@GROUP.add("guide_records", _g("select doc_id, row_number() over (partition by doc_id order by k) as rec, idx, mult, xpath, tag, type, iso_name, length, usage_rule, rulebook, row_color, is_choice from g"))
def guide_records(spark, sf_dir):
    return _guide_records(spark, sf_dir).select("doc_id", "rec", "idx", "mult", "xpath", "tag", "type", "iso_name", "length", "usage_rule", "rulebook", "row_color", "is_choice")


@GROUP.add("depth_path", fx.oracle("guide_cells", """
select rec_key, case max(line) when 1 then 'Root Message' when 2 then 'Root Message/Group Header' when 3 then 'Root Message/Group Header/Settlement' when 4 then 'Root Message/Group Header/Settlement Information'
  when 5 then 'Root Message/Credit Transfer' when 6 then 'Root Message/Credit Transfer/Amount' else 'Root Message/Credit Transfer/Amount/Code' end as path from guide_cells group by 1"""))
def depth_path(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "c2"))), lambda x: x["c2"])
    return fx.frame(spark, sf_dir, "guide_cells").groupBy("rec_key").agg(lines.alias("lines")).select("rec_key", rc.depth_path(F.col("lines")).alias("path"))


@GROUP.add("label_values", fx.oracle("guide_cells", """
select rec_key, max(case when line = 1 then split_part(c3, ' ', 3) end) as tag, max(case when line = 3 then concat('Mandatory for ', split_part(c3, 'for ', 2), ' Mandatory for ', split_part(c3, 'for ', 2)) end) as rule, 'free words' as rules
from guide_cells group by 1"""))
def label_values(spark, sf_dir):
    rows = fx.frame(spark, sf_dir, "guide_cells").filter("line in (1, 3)")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("line", "c3"))), lambda x: x["c3"])
    # the block is doubled, so a repeated label has to be appended
    block = F.concat_ws(" ", F.lit("free words"), F.array_join("b", " "), F.element_at("b", -1))
    m = rc.with_label_values(rows.groupBy("rec_key").agg(blocks.alias("b")), block, "m")
    rule = F.try_element_at("m", F.lit("SEPA Usage Rule(s)"))
    return m.select("rec_key", F.split_part(F.try_element_at("m", F.lit("XML Tag")), F.lit(" "), F.lit(1)).alias("tag"), rule.alias("rule"), F.try_element_at("m", F.lit("Rules")).alias("rules"))


LABELS = (("XML Tag", 1, "'T', cast(l_partkey % 10 as varchar)"), ("Type", 1, "'Max35Text'"), ("SEPA Length", 2, "'1 .. ', cast(l_suppkey as varchar)"),
          ("SEPA Usage Rule(s)", 3, "'Mandatory for ', cast(l_suppkey as varchar), case when lines >= 4 then ' continued text' else '' end"), ("ISO Name", 5, "'Nm', cast(l_partkey % 7 as varchar)"),
          ("NPC Rulebook", 6, "'AT-01', case when lines >= 7 then ' xs:choice' else '' end"))


@GROUP.add("label_values_whole", fx.oracle("record_lines", """
select l_orderkey - l_orderkey % 100 as doc_id, rec_key, label, value from (select *, max(line) over (partition by rec_key) as lines from record_lines) cross join lateral (values {}) v(line_no, label, value) where line = line_no""".format(
    ", ".join(f"({n}, '{label}', concat({value}))" for label, n, value in LABELS))))
def label_values_whole(spark, sf_dir):
    """Every label of every whole requirement block: seven lines of six kinds, texts that go on in the next line included."""
    cells = fx.frame(spark, sf_dir, "guide_cells").groupBy("doc_id", "rec_key").agg(F.array_sort(F.collect_list(F.struct("line", "c3"))).alias("b"))
    m = rc.with_label_values(cells, F.array_join(F.transform("b", lambda x: x["c3"]), " "), "m")
    return m.select("doc_id", "rec_key", F.explode("m").alias("label", "value"))


@GROUP.add("drop_structural", _g("select doc_id, idx, tag from g where not is_choice"))
def drop_structural(spark, sf_dir):
    return rc.drop_structural(_guide_records(spark, sf_dir)).select("doc_id", "idx", "tag")


@GROUP.add("section_stats", _g("select doc_id, count(*) as total, count(*) filter (row_color = 'yellow') as yellow, count(*) filter (row_color = 'red') as red, count(*) filter (row_color = 'white') as white from g group by 1"))
def section_stats(spark, sf_dir):
    return rc.section_stats(_guide_records(spark, sf_dir))


@GROUP.add("row_colour", fx.oracle("guide_cells", """
select doc_id, row_no, case when row_no % 10 < 4 then 'yellow' when row_no % 10 in (5, 6) and doc_id % 300 <> 0 then 'red' else 'white' end as row_colour from guide_cells"""))
def row_colour(spark, sf_dir):
    cells = fx.frame(spark, sf_dir, "guide_cells").select(
        "doc_id", F.floor(F.col("row_no") / 10).alias("page_no"), "row_no", (F.col("row_no") % 10).cast("double").alias("top"), (F.col("row_no") % 10 + 0.5).alias("bottom"))
    page = cells.select("doc_id", "page_no").distinct()
    area = lambda top, bottom, r, g, b: F.struct(F.lit(top).alias("top"), F.lit(bottom).alias("bottom"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    soft = F.when(F.col("doc_id") % 300 == 0, area(5.0, 6.5, 0.5, 0.5, 0.5)).otherwise(area(5.0, 6.5, 0.96, 0.58, 0.64))
    rects = page.select("doc_id", "page_no", F.inline(F.array(area(0.0, 4.0, 0.99, 0.98, 0.38), soft)))
    return rc_colour(cells, rects)


def rc_colour(cells, rects):
    return pg.row_colour(cells, rects).select("doc_id", "row_no", F.col("colour").alias("row_colour"))


# ---- change logs -------------------------------------------------------------------

LOG = """x as (select *, last_value(case when line = 3 and marks then 'DS-05  camt.056  (Recall Request)' end ignore nulls) over (partition by doc_id order by row_no rows between unbounded preceding and current row) as carried from log_rows),
h as (select doc_id, rec_key, bool_or(line = 2) as l2, bool_or(line = 4) as l4 from log_rows group by 1, 2),
e as (select x.doc_id, row_number() over (partition by x.doc_id order by row_no) as rec, c0 as number, c1 as section_ref, c2 as element_ref,
  concat(replace(c3, '  ', ' '), case when l2 then ' and the uetr' else '' end, case when l4 then ' more text' else '' end) as description, case when c4 = 'ACC' then 'ACC' else '' end as status,
  case when 'CLAR' in (c4, c5) then 'CLAR' else 'CHAN' end as change_type, case when c2 = 'pacs.008' then 'DS-02  pacs.008  (Credit Transfer)' else coalesce(carried, 'General / Cross-Message') end as dataset, l2
  from x join h using (doc_id, rec_key) where line = 1)"""


def _log(spark, sf_dir):
    rows = fx.frame(spark, sf_dir, "log_rows")
    wide = F.when((F.col("line") == 1) & (F.col("doc_id") % 200 == 0), F.array("c0", "c1", "c2", "c3", "c4", "c5"))
    cells = wide.when(F.col("line") == 1, F.array("c0", "c1", "c2", "c3", "c4")).otherwise(F.array("c0", "c1", "c2", "c3"))
    return rows.select("doc_id", "row_no", cells.alias("cells"))


def _l(body: str) -> str:
    return fx.oracle("log_rows", f"with {LOG}\n{body}")


@GROUP.add("change_log", _l("select * exclude (l2) from e"))
def change_log(spark, sf_dir):
    return rc.change_log(_log(spark, sf_dir)).drop("business_note")


@GROUP.add("business_notes", _l("""
select doc_id, number, concat(case change_type when 'CLAR' then 'Clarification only — no functional change expected; review for alignment.' else 'Content change — may require implementation update.' end,
  '  Length constraint changed — revalidate field values.', case when l2 then '  UETR handling changed — check end-to-end transaction ID logic.' else '' end) as business_note from e"""))
def business_notes(spark, sf_dir):
    return rc.change_log(_log(spark, sf_dir)).select("doc_id", "number", "business_note")


@GROUP.add("change_log_stats", _l("select doc_id, count(*) as total, count(*) filter (change_type = 'CHAN') as chan, count(*) filter (change_type = 'CLAR') as clar, count(*) filter (change_type = 'TYPO') as typo from e group by 1"))
def change_log_stats(spark, sf_dir):
    return rc.change_log_stats(rc.change_log(_log(spark, sf_dir)))


@GROUP.add("stack_reports", _l("""
select 'even' as report, doc_id, number, dataset from e where doc_id % 200 = 0 union all select 'odd', doc_id, number, dataset from e where doc_id % 200 <> 0"""))
def stack_reports(spark, sf_dir):
    from fieldlens.plans.reports import stack_reports as stack

    log = rc.change_log(_log(spark, sf_dir)).select("doc_id", "number", "dataset")
    return stack({"even": log.filter("doc_id % 200 = 0"), "odd": log.filter("doc_id % 200 <> 0")})


@GROUP.add("infer_dataset", """
select l_orderkey, l_linenumber, case l_linenumber when 1 then 'DS-02  pacs.008  (Credit Transfer)' when 2 then 'DS-03  pacs.002  (Negative Confirmation)' when 3 then 'DS-05  camt.056  (Recall Request)'
  when 4 then 'DS-06  camt.029  (Negative Recall Response)' when 5 then 'DS-07  pacs.028  (Status Investigation)' when 6 then 'DS-10  pacs.004  (Positive Response - Originator Recall)' else '' end as dataset from lineitem""")
def infer_dataset(spark, sf_dir):
    phrase = F.element_at(F.array(*[F.lit(x) for x in ("the PACS.008 message", "negative confirmation", "ds-05", "Response to Recall - Neg", "x pacs.028 y", "DS-10 q", "nothing")]), F.col("l_linenumber"))
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rc.infer_dataset(phrase).alias("dataset"))


@GROUP.add("format_once", fx.oracle("log_rows", "select doc_id, row_no, doc_id % 200 = 0 as layout from log_rows where doc_id in (select doc_id from log_rows where line = 1)"))
def format_once(spark, sf_dir):
    n, c4 = F.size("cells"), F.get("cells", F.lit(4))
    layout = F.when(F.element_at("cells", 1).rlike(r"^\d+\.?$"), (n >= 6) & c4.isin(*fixed.LOG_STATUS))
    return rc.format_once(_log(spark, sf_dir), ["doc_id"], "row_no", layout).select("doc_id", "row_no", "layout")


# ---- sections ----------------------------------------------------------------------

def _section_pages(spark, sf_dir):
    pages = pg.read_pages(fx.table(spark, sf_dir, "documents"), lines_per_page=2)
    head = F.concat(F.lit("see 2.1."), F.col("page_no").cast("string"), F.lit(" Use of the Transfer (Pacs.00"), (F.col("page_no") % 4).cast("string"), F.lit(".001.08)"),
                    F.when(F.col("page_no") % 5 == 0, " ......... 11").otherwise(" as follows: "), F.when(F.col("page_no") % 7 == 0, F.lit("\nList of Changes\n")).otherwise(""))
    return pages.withColumn("text", F.concat(head, "raw"))


SECTIONS = """p as (select doc_id, unnest(range(1, cast(ceil(len(string_split(text, chr(10))) / 2.0) as int) + 1)) as page_no from documents),
n as (select doc_id, max(page_no) as n from p group by 1),
s as (select doc_id, page_no, concat('pacs.00', page_no % 4, '.001.08') as message from p where page_no % 5 <> 0)"""


@GROUP.add("sections", f"""with {SECTIONS}
select s.doc_id, concat('2.1.', page_no) as section_number, 'the Transfer' as label, message, page_no as page_start, cast(coalesce(lead(page_no) over (partition by s.doc_id order by page_no) - 1, n) as int) as page_end,
  row_number() over (partition by s.doc_id, message order by page_no) as section_id,
  concat(replace(message, '.', '_'), case when row_number() over (partition by s.doc_id, message order by page_no) > 1 then concat('_', row_number() over (partition by s.doc_id, message order by page_no)) else '' end) as sheet_name
from s join n on s.doc_id = n.doc_id""")
def sections(spark, sf_dir):
    return rc.sections(_section_pages(spark, sf_dir))


@GROUP.add("section_headings", f"with {SECTIONS}\nselect doc_id, page_no as page_start, concat('2.1.', page_no) as section_number, message from s")
def section_headings(spark, sf_dir):
    return rc.section_headings(_section_pages(spark, sf_dir)).select("doc_id", "page_start", "section_number", "message")


@GROUP.add("changes_start", f"with {SECTIONS}\nselect doc_id, min(page_no) as page_no from p where page_no % 7 = 0 and page_no > 6 group by 1")
def changes_start(spark, sf_dir):
    return rc.changes_start(_section_pages(spark, sf_dir))


@GROUP.add("dedupe_first", "select l_orderkey, l_returnflag, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey) = 1")
def dedupe_first(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")
    return rc.dedupe_first(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"])


# ---- runs --------------------------------------------------------------------------

@GROUP.add("carry_forward", """
select event_id, coalesce(last_value(case when event_type = 'signup' then concat('user ', user_id) end ignore nulls) over (order by event_id rows between unbounded preceding and current row), 'General / Cross-Message') as section from events""")
def carry_forward(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    label = F.when(F.col("event_type") == "signup", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return rc.carry_forward(events, [], ["event_id"], label).select("event_id", "section")


@GROUP.add("section_breaks", "select event_id, event_type is distinct from lag(event_type) over (order by event_id) as is_break from events")
def section_breaks(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type")
    return rc.section_breaks(events, [], ["event_id"], "event_type").select("event_id", "is_break")


@GROUP.add("contiguous_blocks", fx.oracle(("cat_v1", "cat_v2"), """
, u as (select a.seq as pos, b.path is not null and a.type = b.type and a.min_occurs = b.min_occurs and a.max_occurs = b.max_occurs as same from cat_v1 a left join cat_v2 b on a.path = b.path)
select min(pos) as first_row, max(pos) as last_row from (select pos, pos - row_number() over (order by pos) as g from u where same) group by g""".replace("\n, u", "with u", 1).lstrip()))
def contiguous_blocks(spark, sf_dir):
    from fieldlens.operators.schema_diff import side_by_side

    rows = side_by_side(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2")).filter("a_seq is not null")
    return rc.contiguous_blocks(rows.withColumn("pos", F.col("a_seq")), [], "pos", F.col("status") == "SAME")


@GROUP.add("instance_number", """
select event_id, event_type, row_number() over (partition by event_type order by event_id) as instance,
  concat(event_type, case when row_number() over (partition by event_type order by event_id) > 1 then concat('_', row_number() over (partition by event_type order by event_id)) else '' end) as name from events""")
def instance_number(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type")
    n = ordered.row_number(events, ["event_type"], ["event_id"], "instance")
    return n.withColumn("name", F.when(F.col("instance") == 1, F.col("event_type")).otherwise(F.concat_ws("_", "event_type", F.col("instance").cast("string"))))
