"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as every contract here counts it (space, tab, line feed to carriage return).
SPACE = r"[\x20\x09-\x0D]"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join that keeps the keys of the left side once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    amount: Column | None = None,
    chunk: Column | None = None,
    chunks: int = 1024,
) -> DataFrame:
    """Add ``name``: what lies before each row inside its group, for groups of any size.

    With no ``amount`` that is the row's number from 0, else the sum of ``amount`` over the rows
    before it. The order is by ``chunk`` (unless given, a hash of the ``order`` columns), then by the
    ``order`` columns. A group is never in one task: rows are numbered inside (group, chunk), and one small
    row per group and chunk carries the totals of the chunks before it. ``df`` is read twice, so
    callers pass written tables. Rows alike in all order columns take their numbers in any order.
    """
    value = F.lit(1) if amount is None else amount
    chunk = F.pmod(F.xxhash64(*order), F.lit(chunks)) if chunk is None else chunk
    src = df.withColumn("_chunk", chunk).withColumn("_v", value.cast("long"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = src.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    carry = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    if amount is None:
        local = F.row_number().over(inside) - 1
    else:
        local = F.coalesce(F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local_df = src.withColumn("_local", local.cast("long"))
    out = join_same(local_df, carry, [*keys, "_chunk"])
    return out.withColumn(name, F.col("_base") + F.col("_local")).drop("_chunk", "_v", "_local", "_base")
