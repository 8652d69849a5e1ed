"""Rates and deltas along time: sliding averages, counter differences, running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.operators import ordered


def per_second(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Messages per (keys, second). At most one row per second leaves each map task."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ticks.groupBy(*keys, second.alias("sec")).agg(F.count("*").alias("n"))


def sliding_rate(counts: DataFrame, keys: Sequence[str], seconds: int = 10, axis: str = "sec") -> DataFrame:
    """Mean messages per second over the last ``seconds``, divided by the non-empty ones only.

    A window of zero or less is a rate of 0.
    """
    if seconds <= 0:
        return counts.withColumn("rate", F.lit(0.0))
    total = ordered.sliding(
        counts,
        keys,
        axis,
        seconds,
        {"_sum": lambda w: F.sum("n").over(w), "_seconds": lambda w: F.count("n").over(w)},
    )
    return total.withColumn("rate", F.col("_sum") / F.col("_seconds")).drop("_sum", "_seconds")


def one_per_instant(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One sample per series and millisecond, the resolution of the sources: the largest value.

    This bounds what a time slot can hold, whatever the series.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return (
        samples.groupBy(*keys, ms.alias("ms"))
        .agg(F.max(value).alias(value))
        .withColumn("ts", F.timestamp_millis("ms"))
    )


def deltas(
    samples: DataFrame, keys: Sequence[str], value: str = "value", slot_s: int = 3600
) -> DataFrame:
    """Difference to the sample before, with seconds between them; null on the first sample."""
    out = ordered.previous(
        samples, keys, "ts", {"_v": value, "_t": "ts"}, ordered.time_chunk("ts", slot_s)
    )
    return out.select(
        *samples.columns,
        (F.col(value) - F.col("_v")).alias("delta"),
        ((F.unix_micros("ts") - F.unix_micros("_t")) / F.lit(1_000_000.0)).alias("seconds"),
    )


def interval_throughput(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Counter growth per second between consecutive samples."""
    return deltas(samples, keys, value).where("delta is not null").withColumn(
        "per_second", F.try_divide(F.col("delta").cast("double"), F.col("seconds"))
    )


def health_deltas(health: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What a health check adds to its counters: changed backlog only, growing drops only.

    Drops count from the highest estimate seen so far, so a fall and recovery adds nothing.
    """
    slot = ordered.time_chunk("ts", 3600)
    top = ordered.prefix(
        health, keys, "ts", slot, maxima_before={"_before": F.col("dropped")}, lags={"_b": "backlog"}
    )
    zero = F.lit(0)
    backlog = F.col("backlog") - F.coalesce("_b", zero)
    drops = F.greatest(F.col("dropped") - F.greatest(F.coalesce("_before", zero), zero), zero)
    return top.select(
        *health.columns,
        F.when(backlog != 0, backlog).alias("backlog_delta"),
        F.when(drops > 0, drops).alias("dropped_delta"),
    )


def progress_marks(batches: DataFrame, every: int = 20_000, seq: str = "batch_id") -> DataFrame:
    """Batches after which the running total has just passed a multiple of ``every``."""
    total = ordered.running_sum(
        batches, [], seq, {"total": F.col("inserted")}, ordered.spread_chunk(batches, seq)
    )
    return total.where(F.col("total") % every < F.col("inserted"))


def every_nth(batches: DataFrame, n: int, seq: str = "batch_id") -> DataFrame:
    """Every n-th batch in arrival order; n of 1 or less keeps all."""
    if n <= 1:
        return batches
    numbered = ordered.row_numbers(batches, [], seq, "_rn", ordered.spread_chunk(batches, seq))
    return numbered.where(F.col("_rn") % n == 0).drop("_rn")


def active_connections(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Open connections per exchange after each event."""
    step = F.when(F.col("status") == "Connected", 1).when(F.col("status") == "Disconnected", -1).otherwise(0)
    return ordered.running_sum(
        log, ["exchange"], seq, {"active": step.cast("bigint")}, ordered.spread_chunk(log, seq)
    )
