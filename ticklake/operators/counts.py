"""Counters: messages, errors and statuses by exchange, symbol and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.functions import connection_message, exchange_tag, uuid4


def per_exchange(ticks: DataFrame) -> DataFrame:
    """Message count per exchange; the grand total has a null exchange."""
    # Counted first: a rollup of the ticks themselves would double every row.
    counts = ticks.groupBy("exchange").agg(F.count("*").alias("n"))
    return counts.rollup("exchange").agg(F.sum("n").alias("n"))


def per_exchange_of(exchanges: DataFrame, ticks: DataFrame) -> DataFrame:
    """Count for each listed exchange, 0 for one that sent nothing."""
    counts = ticks.groupBy("exchange").agg(F.count("*").alias("n"))
    return exchanges.join(counts, "exchange", "left").select(
        "exchange", F.coalesce("n", F.lit(0)).alias("n")
    )


def per_symbol(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("exchange", F.col("ticker").alias("symbol")).agg(F.count("*").alias("n"))


def per_tag(ticks: DataFrame, fallback: str = "unknown") -> DataFrame:
    return ticks.groupBy(exchange_tag(F.col("exchange"), fallback).alias("tag")).agg(F.count("*").alias("n"))


def errors_by_type(errors: DataFrame) -> DataFrame:
    return errors.groupBy(
        "exception_type", F.coalesce("sql_state", F.lit("none")).alias("sql_state")
    ).agg(F.count("*").alias("n"))


def symbol_shares(ticks: DataFrame) -> DataFrame:
    """Count per symbol and its share of all traffic in percent."""
    counts = ticks.groupBy("ticker").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select("ticker", "n", (F.col("n") * 100.0 / total).alias("pct"))


def latest_status(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest status per exchange by arrival."""
    return log.groupBy("exchange").agg(F.max_by("status", seq).alias("status"))


def status_of(exchanges: DataFrame, log: DataFrame) -> DataFrame:
    """Status of each listed exchange, Disconnected when it never reported."""
    return exchanges.join(latest_status(log), "exchange", "left").select(
        "exchange", F.coalesce("status", F.lit("Disconnected")).alias("status")
    )


def status_report(log: DataFrame, ticks: DataFrame) -> DataFrame:
    """One row per exchange that reported a status, with its tick count (0 when none)."""
    counts = ticks.groupBy("exchange").agg(F.count("*").alias("ticks"))
    return latest_status(log).join(counts, "exchange", "left").select(
        "exchange", "status", F.coalesce("ticks", F.lit(0)).alias("ticks")
    )


def connection_rows(events: DataFrame, created_at: Column) -> DataFrame:
    """Status events as rows of the connection log."""
    text = connection_message(F.col("exchange"), F.col("status"), F.col("message"))
    return events.where(F.col("exchange").isNotNull() & F.col("status").isNotNull()).select(
        uuid4().alias("id"),
        "exchange",
        F.col("status").alias("event_type"),
        F.coalesce(text, F.lit("")).alias("message"),
        created_at.alias("created_at"),
    )
