"""Many small files, and many keys of a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldlens.plans import reports
from fieldlens.sources import messages as src
from fieldlens.streaming import messages as sm


def test_many_small_files_are_written_and_read_by_several_tasks(spark, tmp_path):
    """one task wrote all files of a small table, and every few files were a task of their own when read."""
    texts = spark.range(60).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("t"), "id").alias("t")).unionByName(spark.createDataFrame([(None, "none")], "k string, t string"))
    reports.write_texts(texts, f"{tmp_path}/out", "k", "t")
    assert len({f.name.split("-")[1] for f in tmp_path.glob("out/k=*/part-*.txt")}) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = src.whole_files(spark, f"{tmp_path}/out", "*.txt", "k")
        assert read.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted((r["name"] or "", r["value"].rstrip()) for r in read.collect()) == sorted([("", "none"), *((str(i), f"t{i}") for i in range(60))])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_keeps_what_a_table_keeps_with_few_calls(spark, tmp_path, monkeypatch):
    """every key of a stream was a call of its own; null keys and both zeros included."""
    monkeypatch.setattr(sm, "BUCKETS", 4)
    start = datetime(2024, 1, 1)
    keys = [None, 0.0, -0.0, float("nan"), 1.5, *(float(i) for i in range(2, 40))]
    rows = [(i * 100 + n, "ab"[n % 2] if n % 7 else None, k, start + timedelta(hours=5 * n + i % 3)) for n in range(24) for i, k in enumerate(keys)]
    events = spark.createDataFrame(rows, "id int, s string, d double, ts timestamp")
    want = sm.keep_first(events, ["s", "d"], "ts", 30 * 3600)
    for part in range(3):
        events.filter(F.floor((F.dayofmonth("ts") - 1) / 2) == part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = sm.keep_first(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["s", "d"], "ts", 30 * 3600)
        assert "__bucket" in stream._jdf.queryExecution().analyzed().toString()
        sm.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema(events.schema).parquet(f"{tmp_path}/out")
    key = lambda df: sorted((r["id"], str(r["s"]), str(r["ts"])) for r in df.collect())
    assert key(got) == key(want)


def test_stream_key_texts_tell_keys_apart(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 0, 1), ["a, b"]), (1, datetime(2024, 1, 1, 0, 0, 0, 2), ["a, b"]), (1, datetime(2024, 1, 1, 0, 0, 0, 2), ["a", "b"]), (1, None, None)],
                                 "i int, t timestamp, l array<string>")
    assert rows.select(sm._key_text(rows, ["i", "t", "l"])).distinct().count() == 4
