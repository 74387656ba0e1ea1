"""File inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.functions import text as t
from fieldlens.operators import files as fl
from fieldlens.plans import reports
from fieldlens.registry import Group

GROUP = Group()
EXT = "lower(list_extract(string_split(file, '.'), -1))"


def _files(spark, sf_dir):
    return fx.frame(spark, sf_dir, "files")


@GROUP.add("file_inventory", fx.oracle("files", f"select file, folder, concat('.', {EXT}) as ext, floor(size / 1024.0::double * 10 + 0.5) / 10 as size_kb from files where {EXT} in ('xsd', 'xml', 'json')"))
def file_inventory(spark, sf_dir):
    return fl.inventory(_files(spark, sf_dir)).select("file", "folder", "ext", "size_kb")


@GROUP.add("admit_files", fx.oracle("files", f"""
select file, case when {EXT} = 'exe' then 'invalid type' when size > 52428800 then 'too large' when size = 0 then 'empty' else 'ok' end as reason from files"""))
def admit_files(spark, sf_dir):
    return fl.admit(_files(spark, sf_dir), max_files=None).select("file", "reason")


@GROUP.add("admit_batches", fx.oracle("files", f"""
select file, case when count(*) over (partition by batch) > 66 then 'too many files' when {EXT} = 'exe' then 'invalid type' when size > 52428800 then 'too large' when size = 0 then 'empty' else 'ok' end as reason from files"""))
def admit_batches(spark, sf_dir):
    return fl.admit(_files(spark, sf_dir), max_files=66).select("file", "reason")


@GROUP.add("expired_files", fx.oracle("files", "select file, age_hours from files where age_hours > 24"))
def expired_files(spark, sf_dir):
    return fl.expired(_files(spark, sf_dir), 24).select("file", "age_hours")


@GROUP.add("folder_counts", fx.oracle("files", """
select p as folder, count(*) as n_files from (select unnest(list_transform(range(1, len(string_split(folder, '/')) + 1), lambda i: array_to_string(string_split(folder, '/')[1:i], '/'))) as p from files) group by 1"""))
def folder_counts(spark, sf_dir):
    return fl.folder_counts(_files(spark, sf_dir))


@GROUP.add("folder_totals", fx.oracle("files", "select folder, count(*) as n_files, floor(sum(size) / 1048576.0::double * 100 + 0.5) / 100 as size_mb from files group by 1"))
def folder_totals(spark, sf_dir):
    return fl.folder_totals(_files(spark, sf_dir))


@GROUP.add("file_tree", fx.oracle("files", "select distinct false as is_file, folder as name from files union all select true, concat(folder, '/', file) from files"))
def file_tree(spark, sf_dir):
    return fl.tree(_files(spark, sf_dir))


@GROUP.add("safe_names", "select page_id, left(regexp_replace(url, '[\\\\/*?:\\[\\]]', '_', 'g'), 31) as name from pages")
def safe_names(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", t.safe_name("url").alias("name"))


@GROUP.add("unique_names", """
select page_id, case when n = 1 then b else concat(left(b, 9), '_', 1 + row_number() over (partition by left(b, 9), n = 1 order by page_id)) end as name from (
  select page_id, b, row_number() over (partition by b order by page_id) as n from (select page_id, left(regexp_replace(url, '[\\\\/*?:\\[\\]]', '_', 'g'), 12) as b from pages))""")
def unique_names(spark, sf_dir):
    return reports.unique_names(fx.table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id", 12).select("page_id", "name")


@GROUP.add("older_than", "select event_id from events where ts < timestamp '2024-01-10 12:00:00' - interval 48 hours")
def older_than(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return events.filter(fl.older_than("ts", 48, F.expr("timestamp_ntz '2024-01-10 12:00:00'"))).select("event_id")
