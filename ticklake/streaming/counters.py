"""Running counters and shards on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.functions import shard


def running_counts(ticks: DataFrame, keys: Sequence[str] = ("exchange",)) -> DataFrame:
    """Message counts so far; write in ``complete`` or ``update`` mode. A new checkpoint resets them."""
    return ticks.groupBy(*keys).agg(F.count("*").alias("n"))


def sharded(ticks: DataFrame, shards: int) -> DataFrame:
    """Ticks with the shard of their ticker, so that shards hold disjoint tickers.

    Only a column: moving rows by it would put a hot ticker into one task.
    """
    return ticks.withColumn("shard", shard(F.col("ticker"), shards))
