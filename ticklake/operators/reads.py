"""The read API over tick and candle tables. Everything returns a lazy DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_range(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    column: str = "ts",
    closed: str = "both",
) -> DataFrame:
    """Rows within a time range: ``closed="both"`` includes the end, ``"left"`` does not.

    On a table partitioned by day the range is repeated on ``dt``, because Catalyst cannot
    derive a partition filter from ``ts`` alone.
    """
    if closed not in ("both", "left"):
        raise ValueError("closed must be 'both' or 'left'")
    # Literals take the type of the column, so the comparison reaches the parquet scan.
    kind = df.schema[column].dataType
    by_day = "dt" in df.columns
    if start is not None:
        low = F.lit(start.isoformat(sep=" ")).cast(kind)
        df = df.where(F.col(column) >= low)
        if by_day:
            df = df.where(F.col("dt") >= F.lit(start.date()))
    if end is not None:
        high = F.lit(end.isoformat(sep=" ")).cast(kind)
        df = df.where(F.col(column) <= high if closed == "both" else F.col(column) < high)
        if by_day:
            df = df.where(F.col("dt") <= F.lit(end.date()))
    return df


def by_ticker(df: DataFrame, ticker: str, start=None, end=None) -> DataFrame:
    return time_range(df.where(F.col("ticker") == ticker), start, end).orderBy("ts")


def by_exchange(df: DataFrame, exchange: str, start=None, end=None) -> DataFrame:
    return time_range(df.where(F.col("exchange") == exchange), start, end).orderBy("ts")


def candles_by_interval(df: DataFrame, ticker: str, interval: str, start=None, end=None) -> DataFrame:
    rows = df.where((F.col("ticker") == ticker) & (F.col("interval") == interval))
    return time_range(rows, start, end, "start_time").orderBy("start_time")


def find(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)


def received_ms(row_id: str) -> int | None:
    """The millisecond that a time-ordered id (version 7) was made in; None for other ids."""
    digits = str(row_id).replace("-", "").lower()
    whole = len(digits) == 32 and all(c in "0123456789abcdef" for c in digits)
    return int(digits[:12], 16) if whole and digits[12] == "7" else None


def by_id(df: DataFrame, row_id, column: str = "id", received: str | None = "received_at") -> DataFrame:
    """The row with this id.

    Ids of this library carry the time their row was received, so the look-up is also one of a millisecond of
    ``received``: files and row groups of other times are skipped by their min and max, those of this time by
    the Bloom filter of the id where folding has written one. For ids that come from elsewhere pass ``received=None``.
    """
    found = df.where(F.col(column) == F.lit(row_id))
    ms = received_ms(row_id) if received in df.columns else None
    if ms is not None:
        kind = df.schema[received].dataType
        low, high = (F.timestamp_millis(F.lit(m)).cast(kind) for m in (ms, ms + 1))
        found = found.where((F.col(received) >= low) & (F.col(received) < high))
    return found.limit(1)


def _tie(df: DataFrame) -> list:
    """What decides between rows of one instant, so that a limit cuts the same rows each time."""
    return [F.col(c) for c in ("trade_id", "id") if c in df.columns]


def unnormalized(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Oldest ticks not yet normalized (top-k: each task keeps at most ``limit`` rows)."""
    return df.where(~F.col("normalized")).orderBy("ts", *_tie(df)).limit(limit)


def newest(df: DataFrame, ticker: str, limit: int = 1000) -> DataFrame:
    return df.where(F.col("ticker") == ticker).orderBy(F.col("ts").desc(), *_tie(df)).limit(limit)


def exists(df: DataFrame, ticker: str, exchange: str, ts: datetime) -> bool:
    rows = df.where((F.col("ticker") == ticker) & (F.col("exchange") == exchange))
    return not time_range(rows, ts, ts).isEmpty()


def count(df: DataFrame, start=None, end=None) -> int:
    return time_range(df, start, end).count()


def ticker_range(df: DataFrame, ticker: str, start: datetime, end: datetime) -> DataFrame:
    """Half-open range read of one ticker."""
    return time_range(df.where(F.col("ticker") == ticker), start, end, closed="left")


def count_range(df: DataFrame, ticker: str, start: datetime, end: datetime) -> DataFrame:
    return ticker_range(df, ticker, start, end).agg(F.count("*").alias("n"))


def first_by_prefix(lines: DataFrame, prefix: str, seq: str = "line_no", text: str = "line") -> DataFrame:
    """The first line that starts with a prefix."""
    return lines.where(F.col(text).startswith(prefix)).orderBy(seq).limit(1)
