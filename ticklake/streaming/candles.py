"""Candles on streams."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticklake import files
from ticklake.operators.candles import CANDLE_KEY, merge_partials, ohlcv
from ticklake.schemas import PARTIAL_CANDLE
from ticklake.session import adaptive
from ticklake.sinks.candles import write_batch


def closed_candles(
    ticks: DataFrame, interval_s: int, delay: str = "10 seconds", order: str = "arrival"
) -> DataFrame:
    """Candles emitted once, when the watermark passes their end; later ticks are dropped.

    The dropped ones show in the query progress as numRowsDroppedByWatermark.
    """
    return ohlcv(ticks.withWatermark("ts", delay), interval_s, order)


def open_candles(
    ticks: DataFrame, closed: DataFrame, interval_s: int, watermark: datetime | None = None
) -> DataFrame:
    """The final flush: candles of the stored ticks whose bucket was never emitted.

    With the stream's last ``watermark`` only buckets that end after it are looked at: all others
    were emitted, or their ticks came too late. Days before it are then not read.
    """
    if watermark is not None:
        since = watermark - timedelta(seconds=interval_s)
        ticks = ticks.where(F.col("ts") > F.lit(since))
        if "dt" in ticks.columns:
            ticks = ticks.where(F.col("dt") >= F.lit(since.date()))
    whole = ohlcv(ticks, interval_s)
    if watermark is not None:
        whole = whole.where(F.col("end_time") > F.lit(watermark))
    return whole.join(closed.select(*CANDLE_KEY), CANDLE_KEY, "left_anti").select(*whole.columns)


def write_partials(
    ticks: DataFrame, interval_s: int, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Candles without a lateness limit: each batch writes partial candles of its own ticks.

    A late tick becomes one more partial row of its bucket. No state is kept at all, and a
    replayed batch overwrites its folder. ``read_merged`` combines the rows.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        with adaptive(batch.sparkSession):
            write_batch(ohlcv(batch, interval_s), batch_id, path, files.stream_id(batch.sparkSession, checkpoint))

    return (
        ticks.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Partial candles as written: a bucket has one row per batch that touched it."""
    return spark.read.schema(PARTIAL_CANDLE).parquet(path)


def read_merged(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Merged candles, of the days from ``first`` to ``last`` (inclusive) if given."""
    rows = read_partials(spark, path)
    if first is not None:
        rows = rows.where(F.col("dt") >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col("dt") <= F.lit(last))
    return merge_partials(rows)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Buckets that more than one batch emitted, with how often."""
    rows = read_partials(spark, path)
    return rows.groupBy(*CANDLE_KEY).agg(F.count("*").alias("rows")).where("rows > 1")
