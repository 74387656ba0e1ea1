"""Streaming twins and the SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.functions.register import register
from fieldlens.queries.messages import ISSUES, OK, messages
from fieldlens.registry import Group
from fieldlens.session import scratch_folder
from fieldlens.streaming import messages as sm

GROUP = Group()


def _event_stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _finish(spark, stream, name):
    out = scratch_folder(spark, name)
    sm.run_available(stream, f"{out}/rows", f"{out}/state")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


WINDOWS = """select epoch_us(s) // 1000000 as window_start, event_type, count(*) filter (event_type <> 'error') as passed, count(*) filter (event_type = 'error') as failed
from (select *, date_trunc('day', ts) as s from events) {where} group by 1, 2"""


@GROUP.add("stream_pass_rate_windows", WINDOWS.format(where="where s + interval 1 day <= (select max(ts) from events) - interval 1 hour"))
def stream_pass_rate_windows(spark, sf_dir):
    """Day windows closed by the watermark."""
    stream = sm.pass_rate_windows(_event_stream(spark, sf_dir), "ts", F.col("event_type") != "error", "1 day", by=("event_type",))
    rows = _finish(spark, stream, "windows")
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "passed", "failed")


@GROUP.add("batch_pass_rate_windows", WINDOWS.format(where=""))
def batch_pass_rate_windows(spark, sf_dir):
    rows = sm.pass_rate_windows(fx.table(spark, sf_dir, "events"), "ts", F.col("event_type") != "error", "1 day", by=("event_type",))
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "passed", "failed")


@GROUP.add("sliding_pass_rate", """
select (epoch_us(ts) // 43200000000 - k) * 43200 as window_start, count(*) filter (event_type <> 'error') as passed, count(*) filter (event_type = 'error') as failed
from events cross join (select unnest([0, 1]) as k) group by 1""")
def sliding_pass_rate(spark, sf_dir):
    rows = sm.pass_rate_windows(fx.table(spark, sf_dir, "events"), "ts", F.col("event_type") != "error", "1 day", slide="12 hours")
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "passed", "failed")


@GROUP.add("stream_dedupe", "select distinct user_id, event_type from events")
def stream_dedupe(spark, sf_dir):
    stream = sm.dedupe_stream(_event_stream(spark, sf_dir), ["user_id", "event_type"], "ts").select("user_id", "event_type")
    return _finish(spark, stream, "dedupe")


KEPT = """with recursive e as (select user_id, event_type, epoch_us(ts) as us, min(event_id) as event_id from events group by all),
k as (select user_id, event_type, min(us) as us from e group by all
  union all select k.user_id, k.event_type, (select min(e.us) from e where e.user_id = k.user_id and e.event_type = k.event_type and e.us >= k.us + 259200000000) as us from k
  where us is not null)
select e.event_id, e.user_id, e.event_type from k join e using (user_id, event_type, us)"""
THREE_DAYS = 3 * 86400


@GROUP.add("keep_first", KEPT)
def keep_first(spark, sf_dir):
    """The first event of a user and type, then none for three days, then the next."""
    return sm.keep_first(fx.table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", THREE_DAYS).select("event_id", "user_id", "event_type")


@GROUP.add("stream_keep_first", KEPT)
def stream_keep_first(spark, sf_dir):
    """The same from a stream that gets the events in four parts."""
    events, out = fx.table(spark, sf_dir, "events"), scratch_folder(spark, "keep-first")
    for part in range(4):
        events.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)) == part).write.mode("append").parquet(f"{out}/landed")
        stream = sm.keep_first(spark.readStream.schema(events.schema).parquet(f"{out}/landed"), ["user_id", "event_type"], "ts", THREE_DAYS)
        sm.run_available(stream, f"{out}/rows", f"{out}/state")
    return spark.read.schema(events.schema).parquet(f"{out}/rows").select("event_id", "user_id", "event_type")


@GROUP.add("stream_validate", fx.oracle("msg_leaf", f"with {OK}{ISSUES}\nselect msg_id, severity, category, element from i"))
def stream_validate(spark, sf_dir):
    landed = scratch_folder(spark, "landed")
    messages(spark, sf_dir).write.parquet(landed)
    stream = sm.validate_stream(spark.readStream.schema("msg_id bigint, xml string").parquet(landed))
    return _finish(spark, stream, "issues").select("msg_id", "severity", "category", "element")


@GROUP.add("sql_functions", fx.oracle("cat_v1", """
select path, list_extract(string_split(path, '/'), -1) as last, regexp_replace(path, '/?[^/]*$', '') as parent, len(string_split(path, '/')) - 1 as depth, concat(min_occurs, '..', max_occurs) as mult, min_occurs as low, 1.0 as similarity from cat_v1"""))
def sql_functions(spark, sf_dir):
    register(spark)
    return fx.frame(spark, sf_dir, "cat_v1").selectExpr(
        "path", "fl_last_segment(path) as last", "fl_parent_path(path) as parent", "fl_depth(path) as depth", "fl_multiplicity(min_occurs, max_occurs) as mult",
        "fl_min_of(fl_multiplicity(min_occurs, max_occurs)) as low", "fl_path_similarity(path, path) as similarity")


@GROUP.add("sql_flatten_xml", fx.oracle("msg_leaf", "select msg_id, path, value from msg_leaf where msg_id % 97 <> 0"))
def sql_flatten_xml(spark, sf_dir):
    register(spark)
    return spark.sql("select m.msg_id, n.path, n.value from {m} m, lateral fl_flatten_xml(m.xml) n where n.value is not null and n.kind <> 'parse_error'", m=messages(spark, sf_dir))
