"""Streams of messages and results: the batch rules on landing files, windows, de-duplication."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldlens.operators import validate as vd
from fieldlens.session import checkpoint


def message_stream(spark: SparkSession, path: str, glob: str = "*.xml", max_files: int = 10_000) -> DataFrame:
    """Messages landing in a folder: (msg_id, xml)."""
    return (spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).option("wholetext", "true").text(path)
            .select(F.col("_metadata.file_name").alias("msg_id"), F.col("value").alias("xml")))


def validate_stream(messages: DataFrame, doc_id: str = "msg_id", xml: str = "xml") -> DataFrame:
    """Issues of streamed messages; the rules are local to a message, so nothing is kept between batches."""
    return vd.validate(messages, doc_id, xml)


def pass_rate_windows(results: DataFrame, ts: str, valid: Column, length: str = "1 hour", slide: str | None = None, late: str = "1 hour",
                      by: tuple[str, ...] = ()) -> DataFrame:
    """Passed and failed results per time window; rows later than the watermark are dropped."""
    timed = results.withColumn("__ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("__ts", late)
    window = F.window("__ts", length, slide) if slide else F.window("__ts", length)
    counted = timed.withColumn("__ok", valid).groupBy(window.alias("w"), *by).agg(F.count_if("__ok").alias("passed"), F.count_if(~F.col("__ok")).alias("failed"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "passed", "failed")


def dedupe_stream(rows: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """Rows whose key was not seen within the retention period; state is bounded by the watermark.

    A stream forgets a key some time after its period, when the watermark of a micro-batch has passed it; ``keep_first`` is exact.
    """
    timed = rows.withColumn("__ts", F.col(ts).cast("timestamp"))
    if not rows.isStreaming:
        return keep_first(rows, keys, ts, rows.sparkSession.range(1).select(F.expr(f"unix_seconds(timestamp_seconds(0) + interval '{ttl}')")).first()[0])
    return timed.withWatermark("__ts", ttl).dropDuplicatesWithinWatermark(keys).drop("__ts")


# ---- keep, skip for a while, keep again ----------------------------------------------

BUCKETS = 1024  # states of a stream; part of what its checkpoint holds


def keep_first(rows: DataFrame, keys: list[str], ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """The first row of a key, then none for ``seconds``, then the next one again: the same rows of a table and of a stream in order of time.

    Of rows with the same key and time the smallest one counts; rows without a time are left out. A stream keeps one number a key until the
    watermark has passed its retention, at the latest that of the keys beside it; a row that comes after rows of a later time counts as seen.
    """
    timed = rows.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).filter("__us is not null")
    return (_keep_streamed if rows.isStreaming else _keep_stored)(timed, rows.columns, keys, seconds * 1_000_000, late)


def _keep_stored(timed: DataFrame, columns: list[str], keys: list[str], span: int, late: str) -> DataFrame:
    """Next-kept pointers, doubled: after n rounds the first 2^n kept rows of every key are known."""
    one = checkpoint(timed.groupBy(F.struct(*keys).alias("k"), "__us").agg(F.min(F.struct(*columns)).alias("r")))
    after = W.partitionBy("k").orderBy("__us").rangeBetween(span, W.unboundedFollowing)
    jump = checkpoint(one.select("k", "__us", F.min("__us").over(after).alias("next")).filter("next is not null"))
    kept = new = checkpoint(one.groupBy("k").agg(F.min("__us").alias("__us")))
    while True:
        # jump leads 2^n kept rows on, so what it finds from the known ones is new
        new = checkpoint(kept.join(jump, ["k", "__us"]).select("k", F.col("next").alias("__us")))
        if new.isEmpty():
            break
        kept = checkpoint(kept.unionByName(new))
        further = jump.select("k", F.col("__us").alias("next"), F.col("next").alias("then"))
        jump = checkpoint(jump.join(further, ["k", "next"]).select("k", "__us", F.col("then").alias("next")))
    return one.join(kept, ["k", "__us"], "left_semi").select("r.*")


def _key_text(rows: DataFrame, keys: list[str]) -> Column:
    """One text a key, the same for values that a grouping takes for the same."""
    def one(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), rows.schema[name].dataType.simpleString()
        if kind in ("float", "double"):
            return (c + F.lit(0.0).cast(kind)).cast("string")  # of two signs of zero one
        if kind == "binary":
            return F.base64(c)
        return c if "<" in kind else c.cast("string")

    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*[one(k).alias(f"k{i}") for i, k in enumerate(keys)]), exact)


def _keep_streamed(timed: DataFrame, columns: list[str], keys: list[str], span: int, late: str) -> DataFrame:
    """One number a key, the time of the row kept last; the keys of a bucket share a call and a state."""
    marked = timed.withColumn("__ts", F.timestamp_micros("__us")).withWatermark("__ts", late)
    marked = marked.withColumn("__key", _key_text(timed, keys)).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(BUCKETS)).cast("int"))

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = json.loads(state.get[0]) if state.exists else {}
        timed_out, kept = state.hasTimedOut, None
        if not timed_out:
            group = pd.concat(list(parts), ignore_index=True)
            group = group.sort_values(["__us", *[c for c in columns if c not in keys]], kind="stable", na_position="first")
            keep = []
            for place, key, at in zip(group.index, group["__key"].tolist(), group["__us"].tolist()):
                last = seen.get(key)
                if last is None or at >= last + span:
                    keep.append(place)
                    seen[key] = at
            kept = group.loc[keep, columns]
        over = lambda last: (last + span) // 1000 + 1
        now = state.getCurrentWatermarkMs()
        seen = {key: last for key, last in seen.items() if over(last) > now}
        if seen:
            state.update((json.dumps(seen),))
            state.setTimeoutTimestamp(max(map(over, seen.values())))
        elif timed_out or state.exists:
            state.remove()
        if kept is not None:
            yield kept

    schema = marked.select(*columns).schema
    return marked.groupBy("__bucket").applyInPandasWithState(step, schema, "seen string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, write it as Parquet and stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query
