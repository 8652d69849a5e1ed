"""OHLCV candles: built from ticks, merged from partial candles, checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.functions import bucket_window, interval_label, truncate_price, uuid4

CANDLE_KEY = ["ticker", "exchange", "interval", "start_time", "end_time"]


def _order(order: str, seq: str, ts: str) -> Column:
    """What decides open and close: the arrival number, or event time with arrival as tie-break.

    Both are fixed-width numbers, which keeps min_by / max_by inside hash aggregation.
    """
    if order == "arrival":
        return F.col(seq)
    if order == "event_time":
        micros = F.unix_micros(F.col(ts)).cast("decimal(18,0)")
        return micros * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(seq).cast("decimal(19,0)")
    raise ValueError(f"order must be 'arrival' or 'event_time', not {order!r}")


def ohlcv(ticks: DataFrame, interval_s: int, order: str = "arrival", seq: str = "trade_id") -> DataFrame:
    """One candle per (ticker, exchange, bucket).

    A single aggregation with map-side combine, so a hot ticker or bucket shrinks to one
    row per task before the shuffle. Works on batch and on streaming input. Ticks without an
    arrival number decide open and close, by event time, where a bucket has no others.
    """
    rank, clock = _order(order, seq, "ts"), F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        ticks.groupBy(bucket_window(F.col("ts"), interval_s).alias("w"), "ticker", "exchange")
        .agg(
            F.coalesce(F.min_by("price", rank), F.min_by("price", clock)).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.coalesce(F.max_by("price", rank), F.max_by("price", clock)).alias("close"),
            F.sum("volume").alias("volume"),
            F.count("*").alias("ticks"),
            F.min(seq).alias("first_seq"),
            F.max(seq).alias("last_seq"),
        )
        .select(
            "ticker",
            "exchange",
            interval_label(interval_s).alias("interval"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            F.col("w.start").alias("start_time"),
            F.col("w.end").alias("end_time"),
            "ticks",
            "first_seq",
            "last_seq",
        )
    )


_MERGED = (
    lambda: F.coalesce(F.min_by("open", "first_seq"), F.min_by("open", "start_time")).alias("open"),
    lambda: F.max("high").alias("high"),
    lambda: F.min("low").alias("low"),
    lambda: F.coalesce(F.max_by("close", "last_seq"), F.max_by("close", "start_time")).alias("close"),
    lambda: F.sum("volume").alias("volume"),
    lambda: F.sum("ticks").alias("ticks"),
    lambda: F.min("first_seq").alias("first_seq"),
    lambda: F.max("last_seq").alias("last_seq"),
)


def merge_partials(candles: DataFrame) -> DataFrame:
    """Combine the candles that several batches emitted for the same bucket."""
    return candles.groupBy(*CANDLE_KEY).agg(*[make() for make in _MERGED]).select(
        "ticker", "exchange", "interval", "open", "high", "low", "close", "volume",
        "start_time", "end_time", "ticks", "first_seq", "last_seq",
    )


def coarsen(candles: DataFrame, interval_s: int) -> DataFrame:
    """Roll finer candles up to a longer interval (a multiple of theirs)."""
    return (
        candles.groupBy(bucket_window(F.col("start_time"), interval_s).alias("w"), "ticker", "exchange")
        .agg(*[make() for make in _MERGED])
        .select(
            "ticker", "exchange", interval_label(interval_s).alias("interval"),
            "open", "high", "low", "close", "volume",
            F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"),
            "ticks", "first_seq", "last_seq",
        )
    )


def to_rows(candles: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Candles as rows of the candle table: id, storable decimals, creation time, day."""
    prices = [truncate_price(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return candles.where(
        F.col("ticker").isNotNull() & F.col("interval").isNotNull()
    ).select(
        uuid4().alias("id"),
        "ticker",
        "exchange",
        "interval",
        *prices,
        "start_time",
        "end_time",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.to_date("start_time").alias("dt"),
    )


def violations(candles: DataFrame) -> DataFrame:
    """Candles whose values contradict each other, with the broken rules listed."""
    rules = {
        "high_below_open": F.col("high") < F.col("open"),
        "high_below_close": F.col("high") < F.col("close"),
        "high_below_low": F.col("high") < F.col("low"),
        "low_above_open": F.col("low") > F.col("open"),
        "low_above_close": F.col("low") > F.col("close"),
        "no_volume": ~(F.col("volume") > 0),
    }
    broken = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return candles.withColumn("broken", broken).where(F.col("broken") != "")
