"""Partition maintenance of day-partitioned tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake import files


def is_partitioned(spark: SparkSession, path: str, column: str = "dt") -> bool:
    """Whether the path is a table partitioned by ``column``; false when it does not exist."""
    return bool(files.partition_folders(spark, path, column))


def partitions(spark: SparkSession, path: str, column: str = "dt") -> list[str]:
    """Partition values, sorted, from folder names alone."""
    return sorted(files.partition_folders(spark, path, column))


def partition_rows(table: DataFrame, column: str = "dt") -> DataFrame:
    """Rows per partition; only the footers of the files are needed."""
    return table.groupBy(column).agg(F.count("*").alias("rows"))


def expired(spark: SparkSession, path: str, today: date, retention_days: int, column: str = "dt") -> list[str]:
    """Partitions strictly older than ``today - retention_days``; names that are no date are kept."""
    if retention_days <= 0:
        return []
    cutoff = today - timedelta(days=retention_days)
    days = {name: files.parse_day(name) for name in partitions(spark, path, column)}
    return [name for name, day in days.items() if day is not None and day < cutoff]


def drop_expired(
    spark: SparkSession,
    path: str,
    today: date,
    retention_days: int,
    allow_drop: bool = False,
    column: str = "dt",
) -> list[str]:
    """Drop expired partitions and return them; without ``allow_drop`` nothing is deleted."""
    old = expired(spark, path, today, retention_days, column)
    if allow_drop:
        folders = files.partition_folders(spark, path, column)
        for name in old:
            files.delete(spark, folders[name])
        return old
    return []


def convert_to_partitioned(spark: SparkSession, path: str, ts: str = "ts") -> None:
    """Rewrite an unpartitioned table by day and put it in place of the old one.

    The new table is complete before anything moves; the old one is renamed, not deleted.
    """
    if is_partitioned(spark, path):
        return
    fresh = path.rstrip("/") + "__partitioned"
    rows = spark.read.parquet(path).withColumn("dt", F.to_date(ts))
    rows.hint("rebalance", F.col("dt")).write.mode("overwrite").partitionBy("dt").parquet(fresh)
    files.rename(spark, path, path.rstrip("/") + "__before")
    files.rename(spark, fresh, path)


def copy_table(spark: SparkSession, source: DataFrame, target: str) -> None:
    """Append every row of one table to another, matching columns by name."""
    if files.has_data(spark, target):
        stored = spark.read.parquet(target)
        source = source.select(*stored.columns)
    if "dt" not in source.columns:
        source.write.mode("append").parquet(target)
        return
    # Spread by day, so that a day becomes few files and a hot day many tasks.
    source.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(target)


def maintain(
    spark: SparkSession, path: str, today: date, retention_days: int, allow_drop: bool = True
) -> dict[str, list[str]]:
    """One maintenance run: skipped when the table is missing or not partitioned."""
    if not is_partitioned(spark, path):
        return {"dropped": [], "skipped": [path]}
    return {"dropped": drop_expired(spark, path, today, retention_days, allow_drop), "skipped": []}

