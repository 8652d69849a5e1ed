"""Quantiles of any range of time from a small stored table: mergeable KLL sketches per series and slot.

Raw samples are read once. A sketch holds at most some hundred values however many samples it saw, and sketches merge
to that of all their samples, in any order; so a quantile over a day or a month reads a row per series and slot.
The answer is a value whose rank is off by at most ``rank_error(k)`` of all samples (with 99 % confidence);
series of up to about ``k`` samples are exact. Nulls and NaN are not counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, LongType, StructField, StructType, TimestampType

#: Size of a sketch: the rank is off by 1.3 % at 200, by 0.3 % at 1000.
K = 400
SLOT_S = 60


def rank_error(k: int = K) -> float:
    """Largest part of the samples that a rank is off by, with 99 % confidence (published fit of the KLL sketch)."""
    return 2.296 / k**0.9021


def sketched(samples: DataFrame, keys: Sequence[str], value: str = "value", slot_s: int = SLOT_S, k: int = K) -> DataFrame:
    """(keys, ts, value) -> (keys, slot, n, sketch, dt): a row per series and slot; samples combine on the map side."""
    number = F.col(value).cast("double")
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slot_s) * slot_s).alias("slot")
    rows = samples.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys, slot)
    made = rows.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"))
    return made.withColumn("dt", F.to_date("slot"))


def write(sketches: DataFrame, path: str) -> None:
    """Append sketches to their table, by day. A slot may have several rows: they merge like any others."""
    sketches.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)


def read(
    spark: SparkSession, path: str, keys: StructType, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """The sketches of slots from ``start`` up to ``end``; only the days in between are listed."""
    rest = [StructField("slot", TimestampType()), StructField("n", LongType()), StructField("sketch", BinaryType())]
    rows = spark.read.schema(StructType([*keys.fields, *rest, StructField("dt", DateType())])).parquet(path)
    if start is not None:
        rows = rows.where((F.col("slot") >= F.lit(start)) & (F.col("dt") >= F.lit(start.date())))
    if end is not None:
        rows = rows.where((F.col("slot") < F.lit(end)) & (F.col("dt") <= F.lit(end.date())))
    return rows


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per series, of whatever slots the rows are."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))


def quantiles(sketches: DataFrame, keys: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """(keys, n and a column per wanted quantile) over the slots of the rows."""
    whole = merged(sketches, keys)
    return whole.select(*keys, "n", *[quantile(F.col("sketch"), q).alias(name) for name, q in wanted.items()])
