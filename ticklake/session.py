"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Times with a min and max in the footers; the default (INT96) has none, and no filter on a time would skip anything.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Lists of keys reach the scan as they are, not as the range they span.
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    # Batches that go to Python stay small also where a row is a long text.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

_local_base: str | None = None


def local_session(cores: str = "8", app: str = "ticklake", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        # No call-site capture for every Column call: it costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on (UTC above all).

    Python workers are told where this package lies, as they need not start in its folder.
    """
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])
    return spark


@contextmanager
def adaptive(spark: SparkSession):
    """Adaptive execution inside ``foreachBatch``, where the stream's own session has it off.

    Without it a rebalance by day would send a batch, which is mostly one day, to one task.
    """
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield spark
    finally:
        spark.conf.set(key, before)


def scratch_base(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to a temporary folder: there driver and executors
    share one disk, which is not so on a cluster.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="ticklake-")
    return _local_base


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared scratch folder."""
    return f"{scratch_base(spark).rstrip('/')}/ticklake-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write a frame to the shared scratch folder and go on from the files.

    For frames that a query needs more than once: the plan above runs a single time, later
    steps read only the columns they use, and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
