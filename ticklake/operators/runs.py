"""Reports over rows of measured runs (write and read timings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timings(runs: DataFrame, test: str = "test_name", ms: str = "elapsed_ms", rows: str = "rows") -> DataFrame:
    """Mean, best and worst time per test and the row count of its last iteration."""
    return runs.groupBy(test).agg(
        F.count("*").alias("iterations"),
        (F.sum(ms).cast("double") / F.count(ms)).alias("avg_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.max_by(rows, "iteration").alias("rows"),
    )


def best_per_mode(runs: DataFrame, tie: str = "run_id") -> DataFrame:
    """Run with the most ticks per second in each mode; the earliest run wins a tie."""
    best = F.max_by(
        F.struct("method", "chunk_size", "ticks_per_sec", tie), F.struct("ticks_per_sec", -F.col(tie))
    )
    return runs.groupBy("mode").agg(best.alias("b")).select(
        "mode", "b.method", "b.chunk_size", "b.ticks_per_sec", f"b.{tie}"
    )


def throughput(runs: DataFrame) -> DataFrame:
    """Ticks per second by method, mode and chunk size."""
    return runs.groupBy("method", "mode", "chunk_size").agg(
        F.sum("total_ticks").alias("total_ticks"),
        F.sum("elapsed_ms").alias("elapsed_ms"),
        F.try_divide(F.sum("total_ticks") * F.lit(1000.0), F.sum("elapsed_ms").cast("double")).alias("ticks_per_sec"),
    )


def report_order(runs: DataFrame, tie: str = "run_id") -> DataFrame:
    """By method, sequential before parallel, then by chunk size.

    The run breaks ties, so that a sort splits the many runs of one setting over its tasks.
    """
    return runs.orderBy("method", F.when(F.col("mode") == "Sequential", 0).otherwise(1), "chunk_size", tie)
