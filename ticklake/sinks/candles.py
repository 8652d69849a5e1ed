"""Writes of candles and connection events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.operators import candles as ops
from ticklake.operators.counts import connection_rows
from ticklake.sources.tables import CANDLE_TABLE, read_days

# A sink takes the candles of one batch, the batch number and the id of the stream it belongs to.
Sink = Callable[[DataFrame, int, str], None]

#: Stream id of batches that no stream runs.
NO_STREAM = "none"


def append(candles: DataFrame, path: str, created_at: Column | None = None) -> None:
    """Append candles to their table, by day of their start."""
    rows = ops.to_rows(candles, created_at)
    rows.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)


def append_batch(
    candles: DataFrame, batch_id: int, path: str, stream: str = NO_STREAM, created_at: Column | None = None
) -> None:
    """Append the candles of one batch to the candle table; a replay adds nothing.

    A row's id follows from stream, batch and content, so rows that are there already are known
    by their id. Only the days of the batch are read.
    """
    rows = ops.to_rows(candles, created_at)
    held = [c for c in rows.columns if c not in ("id", "created_at", "dt")]
    digest = F.md5(F.to_json(F.struct(F.lit(stream), F.lit(batch_id), *held)))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    uuid = F.concat_ws("-", parts[0], parts[1], F.concat(F.lit("4"), parts[2]), F.concat(F.lit("8"), parts[3]), parts[4])
    rows = rows.withColumn("id", uuid)
    spark = rows.sparkSession
    days = [r.dt for r in rows.select("dt").distinct().collect() if r.dt is not None]  # bounded by the calendar
    stored = read_days(spark, path, days, CANDLE_TABLE).select("id")
    new = rows.join(stored, "id", "left_anti").select(*rows.columns)
    new.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)


def write_batch(candles: DataFrame, batch_id: int, path: str, stream: str = NO_STREAM) -> None:
    """Write the partial candles of one batch to folders of their own, by day, stream and batch.

    A replayed batch overwrites its own folders, so nothing is counted twice, and streams that
    share a path do not touch each other's. Readers of a day open the files of that day only.
    """
    rows = candles.withColumn("dt", F.to_date("start_time")).withColumn("stream", F.lit(stream))
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    (
        rows.hint("rebalance", F.col("dt"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "stream", "batch_id")
        .parquet(path)
    )


def with_fallback(primary: Sink, fallback_path: str, on_error: Callable[[Exception], None] | None = None) -> Sink:
    """A sink that tries ``primary`` and on failure writes the batch to the candle table instead.

    The candles are the same rows in both tries; the fallback is idempotent per stream and batch.
    """

    def sink(candles: DataFrame, batch_id: int, stream: str = NO_STREAM) -> None:
        try:
            primary(candles, batch_id, stream)
        except Exception as error:  # any broker failure leads to the table
            if on_error:
                on_error(error)
            append_batch(candles, batch_id, fallback_path, stream)

    return sink


def append_connection_log(events: DataFrame, path: str, created_at: Column) -> None:
    connection_rows(events, created_at).write.mode("append").parquet(path)
