"""Page text of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.functions import lists
from fieldlens.operators import pages as pg
from fieldlens.registry import Group

GROUP = Group()

# The oracle prelude: pages of five lines, and each document with the next one of its source.
PAGES = r"""dl as (select doc_id, source, lang, string_split(text, chr(10)) as lines, text from documents),
pg as (select doc_id, p as page_no, array_to_string(lines[(p - 1) * 5 + 1 : p * 5], chr(10)) as raw,
  trim(regexp_replace(array_to_string(lines[(p - 1) * 5 + 1 : p * 5], chr(10)), '\s+', ' ', 'g'), ' ') as txt
  from (select *, unnest(range(1, cast(ceil(len(lines) / 5.0) as int) + 1)) as p from dl)),
pr as (select * from (select lag(doc_id) over (partition by source order by doc_id) as pair_id, lag(doc_id) over (partition by source order by doc_id) as a, doc_id as b from documents) where pair_id is not null),
pp as (select coalesce(x.pair_id, y.pair_id) as pair_id, coalesce(x.page_no, y.page_no) as page_no, x.txt as atx, y.txt as bt, x.raw as ar, y.raw as br
  from (select pair_id, page_no, txt, raw from pg join pr on doc_id = a) x full join (select pair_id, page_no, txt, raw from pg join pr on doc_id = b) y on x.pair_id = y.pair_id and x.page_no = y.page_no),
ws as (select *, list_filter(list_distinct(string_split_regex(lower(coalesce(atx, '')), '\s+')), lambda w: w <> '') as wa, list_filter(list_distinct(string_split_regex(lower(coalesce(bt, '')), '\s+')), lambda w: w <> '') as wb from pp),
sim as (select *, case when len(wa) = 0 and len(wb) = 0 then 100.0 when len(wa) = 0 or len(wb) = 0 then 0.0
  else floor(1000.0::double * len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) + 0.5) / 10 end as similarity from ws)"""


def _o(body: str) -> str:
    body = body.strip()
    return f"with {PAGES}{body}" if body.startswith(",") else f"with {PAGES}\n{body}"


def _pages(spark, sf_dir):
    return pg.read_pages(fx.table(spark, sf_dir, "documents"))


def _pairs(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return pg.pair_pages(pg.read_pages(docs), pg.pair_documents(docs))


def _scored(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("similarity", pg.page_similarity())


@GROUP.add("read_pages", _o("select doc_id, page_no, txt as text from pg"))
def read_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_no", "text")


@GROUP.add("page_counts", _o("select doc_id, count(*) as pages from pg group by 1"))
def page_counts(spark, sf_dir):
    return pg.page_counts(_pages(spark, sf_dir))


@GROUP.add("pair_pages", _o("select pair_id, page_no, atx is not null as in_a, bt is not null as in_b from pp"))
def pair_pages(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", "page_no", F.col("a_text").isNotNull().alias("in_a"), F.col("b_text").isNotNull().alias("in_b"))


@GROUP.add("page_similarity", _o("""
select pair_id, page_no, similarity, case when atx is null then 'Added in B' when bt is null then 'Only in A' when similarity >= 99 then 'Identical' when similarity >= 70 then 'Similar' else 'Changed' end as badge from sim"""))
def page_similarity(spark, sf_dir):
    return _scored(spark, sf_dir).select("pair_id", "page_no", "similarity", pg.page_badge().alias("badge"))


@GROUP.add("page_stats", _o("""
select pair_id, coalesce(floor(sum(cast(round(s * 10) as bigint))::double / count(s) + 0.5) / 10, 0.0) as mean_similarity, count(*) filter (s >= 99) as identical, count(*) filter (s < 99) as changed, count(bt) - count(atx) as extra_in_b
from (select *, case when atx is not null and bt is not null then similarity end as s from sim) group by 1"""))
def page_stats(spark, sf_dir):
    return pg.page_stats(_scored(spark, sf_dir))


@GROUP.add("line_diff", _o("""
, la as (select pair_id, page_no, unnest(string_split(ar, chr(10))) as line, generate_subscripts(string_split(ar, chr(10)), 1) - 1 as pos from pp where ar is not null),
lb as (select pair_id, page_no, unnest(string_split(br, chr(10))) as line, generate_subscripts(string_split(br, chr(10)), 1) - 1 as pos from pp where br is not null)
select pair_id, page_no, 'a' as side, pos, line, case when exists (select 1 from lb where lb.pair_id = la.pair_id and lb.page_no = la.page_no and lb.line = la.line) then 'eq' else 'del' end as tag from la
union all select pair_id, page_no, 'b', pos, line, 'ins' from lb where not exists (select 1 from la where lb.pair_id = la.pair_id and lb.page_no = la.page_no and lb.line = la.line)"""))
def line_diff(spark, sf_dir):
    return pg.line_diff(_pairs(spark, sf_dir), ("pair_id", "page_no"))


@GROUP.add("word_diff", _o(r"""
, q as (select *, list_filter(string_split_regex(coalesce(atx, ''), '\s+'), lambda w: w <> '') as la, list_filter(string_split_regex(coalesce(bt, ''), '\s+'), lambda w: w <> '') as lb from pp),
wa as (select *, row_number() over (partition by pair_id, page_no, item order by pos) as n from (select pair_id, page_no, unnest(la) as item, generate_subscripts(la, 1) - 1 as pos from q)),
wb as (select *, row_number() over (partition by pair_id, page_no, item order by pos) as n from (select pair_id, page_no, unnest(lb) as item, generate_subscripts(lb, 1) - 1 as pos from q))
select coalesce(wa.pair_id, wb.pair_id) as pair_id, coalesce(wa.page_no, wb.page_no) as page_no, md5(coalesce(wa.item, wb.item)) as item, wa.pos as a_pos, wb.pos as b_pos,
  case when wa.pos is null then 'ins' when wb.pos is null then 'del' else 'eq' end as tag
from wa full join wb on wa.pair_id = wb.pair_id and wa.page_no = wb.page_no and wa.item = wb.item and wa.n = wb.n"""))
def word_diff(spark, sf_dir):
    return pg.word_diff(_pairs(spark, sf_dir)).withColumn("item", F.md5("item"))


@GROUP.add("page_words_only", _o("""
select pair_id, page_no, array_to_string(list_sort(list_filter(wa, lambda w: not list_contains(wb, w))), ' ') as only_left, array_to_string(list_sort(list_filter(wb, lambda w: not list_contains(wa, w))), ' ') as only_right from ws"""))
def page_words_only(spark, sf_dir):
    words = lambda c: F.array_distinct(lists.words(F.lower(F.coalesce(c, F.lit("")))))
    a, b = words(F.col("a_text")), words(F.col("b_text"))
    shown = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    return _pairs(spark, sf_dir).select("pair_id", "page_no", shown(a, b).alias("only_left"), shown(b, a).alias("only_right"))


@GROUP.add("compare_metadata", _o("""
, m as (select d.doc_id, d.lang, d.source, cast(count(*) as varchar) as pages from documents d join pg on pg.doc_id = d.doc_id group by 1, 2, 3),
x as (select pair_id, m.* from pr join m on m.doc_id = a), y as (select pair_id, m.* from pr join m on m.doc_id = b)
select x.pair_id, label, case label when 'lang' then x.lang when 'source' then x.source else x.pages end as left_value, case label when 'lang' then y.lang when 'source' then y.source else y.pages end as right_value,
  case label when 'lang' then x.lang <> y.lang when 'source' then x.source <> y.source else x.pages <> y.pages end as changed
from x join y on x.pair_id = y.pair_id cross join (select unnest(['lang', 'source', 'pages']) as label)"""))
def compare_metadata(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    meta = docs.select("doc_id", "lang", "source").join(pg.page_counts(pg.read_pages(docs)), "doc_id")
    pairs = pg.pair_documents(docs)
    side = lambda c: meta.join(pairs.select("pair_id", F.col(c).alias("doc_id")), "doc_id")
    return pg.compare_metadata(side("left_doc"), side("right_doc"), "pair_id", ("lang", "source", "pages"))


# Documents carry no cover page, so one is put in front of their text from stored columns.
@GROUP.add("doc_metadata", """
select doc_id, concat('EPC', doc_id, '-', n_chars) as doc_number, case when doc_id % 3 = 0 then '' else concat('2024 Version ', doc_id % 9, '.0') end as version,
  case when doc_id % 2 = 0 then '2024-01-15' else concat(doc_id % 28 + 1, ' March 2024') end as date_issued, case when doc_id % 5 = 0 then '2024-11-20' else '' end as date_effective,
  case when lang = 'en' then 'NCT Inst (NPC)' else 'SCT Inst (EPC)' end as scheme
from documents""".replace("concat('EPC', doc_id, '-', n_chars) as doc_number", "case when doc_id % 3 = 0 then '' else concat('EPC', doc_id, '-', n_chars) end as doc_number"))
def doc_metadata(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    number = F.expr("case when doc_id % 3 = 0 then concat('EPC', doc_id) else concat('EPC', doc_id, '-', n_chars, ' / 2024 Version ', doc_id % 9, '.0') end")
    issued = F.expr("case when doc_id % 2 = 0 then 'Date issued: 2024-01-15' else concat('DATE ISSUED: ', doc_id % 28 + 1, ' March 2024') end")
    effective = F.expr("case when doc_id % 5 = 0 then 'Date effective 2024-11-20' else '' end")
    scheme = F.expr("case when lang = 'en' then 'Nordic scheme' else 'SCT Inst' end")
    cover = F.concat_ws("\n", number, issued, effective, scheme, F.lit(""), F.col("text"))
    return pg.doc_metadata(pg.read_pages(docs.withColumn("text", cover)))


@GROUP.add("page_plan", _o("""
, n as (select doc_id, count(*) as pages from pg group by 1)
select doc_id, 'pages' as mode, page_no as part, page_no, concat('page_', page_no) as part_name from pg
union all select doc_id, 'chunks', cast(floor((page_no - 1) / 2) as int) + 1, page_no, concat('part_', cast(floor((page_no - 1) / 2) as int) + 1) from pg
union all select pg.doc_id, 'ranges', 1, page_no, 'pages_1-2' from pg join n on pg.doc_id = n.doc_id and pages >= 2 where page_no <= 2
union all select doc_id, 'ranges', 1, null, 'invalid range: 1-2' from n where pages < 2
union all select pg.doc_id, 'ranges', 2, page_no, 'pages_3-3' from pg join n on pg.doc_id = n.doc_id and pages >= 3 where page_no = 3
union all select doc_id, 'ranges', 2, null, 'invalid range: 3' from n where pages < 3
union all select doc_id, 'ranges', 3, null, 'invalid range: x-1' from n"""))
def page_plan(spark, sf_dir):
    counts = pg.page_counts(_pages(spark, sf_dir))
    plans = [pg.page_plan(counts, "pages"), pg.page_plan(counts, "chunks", chunk=2), pg.page_plan(counts, "ranges", ranges="1-2, 3,x-1")]
    return reduce(lambda x, y: x.unionByName(y), [p.withColumn("mode", F.lit(m)) for p, m in zip(plans, ("pages", "chunks", "ranges"))])


@GROUP.add("concat_pages", _o("select doc_id, page_no, row_number() over (order by doc_id, page_no) as out_page from pg"))
def concat_pages(spark, sf_dir):
    return pg.concat_pages(_pages(spark, sf_dir))


# ---- tables: each conversation is a document, its turns are rows of one table per page of four turns ----

CELLS = """c0 as (select conv_id, turn, cast(turn // 4 as int) + 1 as page_no, role, text from conversations),
ct as (select conv_id, page_no, count(*) as n from c0 group by 1, 2),
cells as (select conv_id as doc_id, c0.page_no, 1 as table_no, cast(turn % 4 as int) + 1 as row_no, k as col_no, trim(regexp_replace(case k when 1 then cast(turn as varchar) when 2 then role else text end, '\\s+', ' ', 'g'), ' ') as text
  from c0 join ct using (conv_id, page_no) cross join (select unnest([1, 2, 3]) as k) where n >= 2)"""


def _tables(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", F.floor(F.col("turn") / 4).alias("p"),
        F.array(F.col("turn").cast("string"), F.concat(F.lit(" "), "role", F.lit("\n")), F.col("text")).alias("row"))
    per_page = rows.groupBy("doc_id", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "row"))), lambda x: x["row"]).alias("tbl"))
    return per_page.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.array("tbl").alias("t")))), lambda x: x["t"]).alias("tables"))


@GROUP.add("page_tables", f"with {CELLS}\nselect doc_id, page_no, table_no, row_no, col_no, text, concat('P', page_no, '_T', table_no) as key from cells")
def page_tables(spark, sf_dir):
    return pg.page_tables(_tables(spark, sf_dir))


@GROUP.add("table_summary", f"with {CELLS}\nselect doc_id, concat('P', page_no, '_T', table_no) as key, max(row_no) - 1 as data_rows, max(col_no) as columns from cells group by 1, 2")
def table_summary(spark, sf_dir):
    return pg.table_summary(pg.page_tables(_tables(spark, sf_dir)))


@GROUP.add("table_compare", f"""with {CELLS}
select a.doc_id as pair_id, coalesce(a.page_no, b.page_no) as page_no, 1 as table_no, coalesce(a.row_no, b.row_no) as row_no, coalesce(a.col_no, b.col_no) as col_no, a.text as left_text, b.text as right_text
from cells a left join cells b on a.doc_id + 1 = b.doc_id and a.page_no = b.page_no and a.row_no = b.row_no and a.col_no = b.col_no where a.text is distinct from b.text
union all select b.doc_id - 1, b.page_no, 1, b.row_no, b.col_no, null, b.text from cells b where not exists (select 1 from cells a where a.doc_id + 1 = b.doc_id and a.page_no = b.page_no and a.row_no = b.row_no and a.col_no = b.col_no)""")
def table_compare(spark, sf_dir):
    cells = pg.page_tables(_tables(spark, sf_dir))
    return pg.table_compare(cells.withColumnRenamed("doc_id", "pair_id"), cells.withColumn("pair_id", F.col("doc_id") - 1))
