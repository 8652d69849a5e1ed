"""Writes to the tick table: insert-if-absent, append, row edits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ticklake.functions import parse_decimal, required, truncate_price, uuid7
from ticklake.operators.dedup import first_arrival
from ticklake.operators.joins import missing_keys
from ticklake.schemas import RAW_TICK, TICK_KEY
from ticklake.session import scratch
from ticklake import files
from ticklake.sources.tables import read_days


def to_rows(ticks: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Ticks as rows of the table: id, storable decimals, arrival time, flag, day."""
    now = F.current_timestamp() if received_at is None else received_at
    return ticks.select(
        uuid7(now).alias("id"),
        "trade_id",
        "ticker",
        "exchange",
        truncate_price(F.col("price")).alias("price"),
        truncate_price(F.col("volume")).alias("volume"),
        F.col("ts").cast("timestamp").alias("ts"),
        now.cast("timestamp").alias("received_at"),
        F.lit(False).alias("normalized"),
        F.to_date(F.col("ts").cast("timestamp")).alias("dt"),
    )


def text_to_ticks(entities: DataFrame) -> DataFrame:
    """Rows whose price and volume are text, as ticks."""
    return entities.withColumn("price", truncate_price(parse_decimal(F.col("price")))).withColumn(
        "volume", truncate_price(parse_decimal(F.col("volume")))
    )


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows spread for a write by day.

    The rebalance hint lets adaptive execution split a hot day over many tasks and put small
    days together; sorting inside a task makes the files' min/max useful for ticker reads.
    """
    return rows.hint("rebalance", F.col("dt")).sortWithinPartitions("dt", "ticker", "ts")


def append(rows: DataFrame, path: str) -> None:
    laid_out(rows).write.mode("append").partitionBy("dt").parquet(path)


def _days(batch: DataFrame) -> list[date]:
    """Days present in a batch; their number is bounded by the calendar."""
    return [r.dt for r in batch.select("dt").distinct().collect() if r.dt is not None]


def refused(ticks: DataFrame) -> DataFrame:
    """Ticks an insert leaves out because their key is incomplete; for the dead letters."""
    return ticks.where(~required(*TICK_KEY))


def new_rows(
    spark: SparkSession, ticks: DataFrame, path: str, staging: str, received_at: Column | None = None
) -> DataFrame:
    """First arrival of each key that the table at ``path`` does not hold yet.

    Copies inside the batch collapse before anything is joined; the result is written to
    ``staging``, because three steps read it. Of the table only the days of the batch and the
    three key columns are read. The caller deletes ``staging`` once the rows are written.
    """
    batch = to_rows(first_arrival(ticks.where(required(*TICK_KEY))), received_at)
    if not files.has_data(spark, path):
        return batch
    batch.write.mode("overwrite").parquet(staging)
    batch = spark.read.schema(batch.schema).parquet(staging)
    return missing_keys(batch, read_days(spark, path, _days(batch)))


def insert_ignore(
    spark: SparkSession, ticks: DataFrame, path: str, received_at: Column | None = None
) -> int:
    """Append the ticks whose key is new; return how many were inserted.

    Running it again with the same ticks inserts nothing, so a retried batch is harmless.
    One writer per table at a time: plain files have no unique constraint.
    """
    counter, staging = Observation("inserted"), scratch(spark, "incoming")
    try:
        rows = new_rows(spark, ticks, path, staging, received_at)
        # Observed in the writing stage itself: there a repeated task counts once.
        counted = laid_out(rows).observe(counter, F.count(F.lit(1)).alias("n"))
        counted.write.mode("append").partitionBy("dt").parquet(path)
        return _observed(counter)
    finally:
        files.delete(spark, staging)


def _observed(counter: Observation) -> int:
    try:
        return counter.get["n"]
    except Py4JJavaError as error:
        # Adaptive execution drops the observer together with an empty result.
        if "assertion failed" in str(error):
            return 0
        raise


def insert_ignore_text(spark: SparkSession, entities: DataFrame, path: str, received_at=None) -> int:
    """The same for rows whose price and volume are text."""
    return insert_ignore(spark, text_to_ticks(entities), path, received_at)


# The VALUES-list form of the same write.
insert_ignore_values = insert_ignore


def staged_insert(
    spark: SparkSession, ticks: DataFrame, path: str, staging: str | None = None, received_at=None
) -> int:
    """Write the batch to a staging folder first, then insert from there; exact count.

    What is inserted then no longer depends on recomputing the input.
    """
    staging = staging or scratch(spark, "staging")
    try:
        ticks.write.mode("overwrite").parquet(staging)
        return insert_ignore(spark, spark.read.schema(ticks.schema).parquet(staging), path, received_at)
    finally:
        files.delete(spark, staging)


class DuplicateTick(ValueError):
    """A plain append met a key that is already there."""


def bulk_append(
    spark: SparkSession, ticks: DataFrame, path: str, strict: bool = False, received_at=None
) -> None:
    """Append without looking for conflicts; with ``strict`` a repeated key is an error."""
    if strict:
        repeated = ticks.groupBy(*TICK_KEY).agg(F.count("*").alias("n")).where("n > 1")
        if not repeated.isEmpty():
            raise DuplicateTick("the batch repeats a key")
        if files.has_data(spark, path):
            batch = to_rows(ticks, received_at)
            stored = read_days(spark, path, _days(batch))
            if not batch.join(stored.select(*TICK_KEY), TICK_KEY, "left_semi").isEmpty():
                raise DuplicateTick("the table already holds a key")
    append(to_rows(ticks, received_at), path)


# --- row edits ----------------------------------------------------------------------------


def _rewrite(spark: SparkSession, path: str, changed: DataFrame, days: list[date]) -> None:
    """Replace the partitions of ``days`` by the rows of ``changed``.

    The new rows are written aside first, because a table cannot be overwritten while it is
    read; days that end up empty lose their folder.
    """
    aside = scratch(spark, "rewrite")
    try:
        laid_out(changed).write.partitionBy("dt").parquet(aside)
        kept = set(files.partition_folders(spark, aside))
        if kept:
            (
                laid_out(spark.read.schema(changed.schema).parquet(aside).select(*changed.columns))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("dt")
                .parquet(path)
            )
    finally:
        files.delete(spark, aside)
    folders = files.partition_folders(spark, path)
    for day in days:
        name = day.isoformat()
        if name not in kept and name in folders:
            files.delete(spark, folders[name])


def delete_rows(spark: SparkSession, path: str, keys: DataFrame, key: Sequence[str] = TICK_KEY) -> None:
    """Remove the rows with these keys; only their days are rewritten."""
    days = _days(keys.select(F.to_date("ts").alias("dt")))
    touched = read_days(spark, path, days)
    rest = touched.join(keys.select(*key).distinct(), list(key), "left_anti").select(*touched.columns)
    _rewrite(spark, path, rest, _days(touched))


def update_rows(
    spark: SparkSession, path: str, edits: DataFrame, columns: Sequence[str], key: Sequence[str] = TICK_KEY
) -> None:
    """Set ``columns`` of the rows with the keys in ``edits``; only their days are rewritten.

    Two edits of one key are an error, as neither is the right one.
    """
    if not edits.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two edits of one key")
    days = _days(edits.select(F.to_date("ts").alias("dt")))
    touched = read_days(spark, path, days)
    new = edits.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = touched.join(new, list(key), "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = joined.select(
        *[
            F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).cast(touched.schema[c].dataType).alias(c)
            if c in columns
            else F.col(c)
            for c in touched.columns
        ]
    )
    _rewrite(spark, path, out, _days(touched))


def mark_normalized(spark: SparkSession, path: str, keys: DataFrame) -> None:
    update_rows(
        spark, path, keys.select(*TICK_KEY).distinct().withColumn("normalized", F.lit(True)), ["normalized"]
    )


def truncate(spark: SparkSession, path: str, schema=RAW_TICK) -> None:
    """Empty a table but keep it readable."""
    spark.createDataFrame([], schema).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)
