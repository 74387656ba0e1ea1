"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "fieldlens") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df: DataFrame, sized: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared checkpoint folder.

    The planner takes the size of what was read for that of the result. Where rows are many times larger, parsed from a few texts, ``sized`` = False
    leaves the size unknown, so that none of them are broadcast through the driver by mistake; adaptive execution still broadcasts what turns out to be small.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own; a cluster without it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="fieldlens-checkpoint-")
        sc.setCheckpointDir(folder)
    kept = df.checkpoint(eager=True)
    if sized:
        return kept
    plan = kept._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), kept._jdf.schema(), False), spark)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for sinks of short-lived runs."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="fieldlens-scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
