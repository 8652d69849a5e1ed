"""Small batches wait until a write is worth it.

A batch whose ticks would make a small write is set aside: its ticks are committed next to the table as pending
entries, which readers do not see. Once the pending ticks reach a number, or the oldest of them an age, one commit
inserts all of them and takes the pending entries out. A batch is known by its mark, so a replay sets nothing
aside twice, and a crash before the release leaves the ticks pending for the next batch or ``flush``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from ticklake import files, versions
from ticklake.functions import required
from ticklake.schemas import TICK, TICK_KEY
from ticklake.session import adaptive
from ticklake.sinks import versioned
from ticklake.versions import Entry, Version

PENDING = "pending"
_HELD = StructType([*TICK.fields, StructField("dt", DateType())])


def hold(ticks: DataFrame, batch_id: int, path: str, stream: str, now_ms: int) -> None:
    """Set the ticks of a batch aside; of a batch that was set aside before, nothing."""
    spark = ticks.sparkSession
    if versions.latest(spark, path).written(stream, batch_id):
        return
    rows = ticks.where(required(*TICK_KEY)).select(*TICK.names, F.to_date("ts").alias("dt"))
    commit, days = versions.write(rows.hint("rebalance", F.col("dt")), path)
    entries = [Entry(commit, d, PENDING, 0, since=now_ms) for d in days]
    counts = {r.dt.isoformat(): r.n for r in versions.frame(spark, path, entries, _HELD).groupBy("dt").agg(F.count("*").alias("n")).collect()}
    entries = [Entry(commit, d, PENDING, 0, counts[d], now_ms) for d in days]

    def attempt(base: Version) -> Version:
        if base.written(stream, batch_id):
            return base
        return versions.commit(spark, path, base, entries, mark=(stream, batch_id, commit))

    versions.retried(spark, path, attempt)


def due(version: Version, rows: int, seconds: float, now_ms: int) -> bool:
    """Whether the pending ticks are enough, or old enough."""
    held = version.of(PENDING)
    return bool(held) and (sum(e.rows for e in held) >= rows or now_ms - min(e.since for e in held) >= seconds * 1000)


def flush(spark: SparkSession, path: str, between=lambda: None) -> int:
    """Insert all pending ticks in one commit; return how many were new."""
    held = versions.latest(spark, path).of(PENDING)
    if not held:
        return 0
    pending = versions.frame(spark, path, held, _HELD).select(*TICK.names)
    return versioned.insert_new(spark, pending, path, drop=held, between=between).count()


def write_stream(
    ticks: DataFrame,
    path: str,
    checkpoint: str,
    rows: int = 100_000,
    seconds: float = 60,
    trigger: dict | None = None,
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Insert a stream of ticks, in writes of at least ``rows`` or as old as ``seconds``. One stream a table.

    What is left at the end of a stream stays pending: ``flush`` inserts it. An age is looked at when a batch comes.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = int(clock() * 1000)
        with adaptive(spark):
            hold(batch, batch_id, path, files.stream_id(spark, checkpoint), now)
            if due(versions.latest(spark, path), rows, seconds, now):
                flush(spark, path)

    return (
        ticks.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
