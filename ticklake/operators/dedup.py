"""Duplicate removal: first arrival per key, and the balance of what was removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, NumericType, TimestampNTZType, TimestampType

from ticklake.schemas import TICK_KEY

_FIXED_WIDTH = (NumericType, DecimalType, TimestampType, TimestampNTZType, DateType, BooleanType)


def first_arrival(df: DataFrame, key: Sequence[str] = TICK_KEY, seq: str = "trade_id") -> DataFrame:
    """Keep the row with the smallest arrival number per key; without any number, one of the rows.

    Rows whose number is null only count where their key has no other; a hash of the row then decides.

    An aggregation, not a row_number window: copies collapse on the map side, so one key
    with very many copies never meets in one task. Fixed-width columns stay in hash
    aggregation; anything else travels as one struct.
    """
    rest = [c for c in df.columns if c not in key and c != seq]
    tie = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")

    def chosen(value) -> Column:
        return F.when(F.min(seq).isNotNull(), F.min_by(value, F.col(seq))).otherwise(F.min_by(value, tie))

    if all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in rest):
        out = df.groupBy(*key).agg(F.min(seq).alias(seq), *[chosen(F.col(c)).alias(c) for c in rest])
    else:
        out = (
            df.groupBy(*key)
            .agg(F.min(seq).alias(seq), chosen(F.struct(*rest)).alias("_rest"))
            .select(*key, seq, "_rest.*")
        )
    return out.select(*df.columns)


def mark_repeats(df: DataFrame, key: Sequence[str] = TICK_KEY, seq: str = "trade_id") -> DataFrame:
    """All rows, with ``repeat`` true on every arrival after the first of its key.

    The first arrivals are joined back on (key, seq), a key no two rows share, so copies of
    one tick spread over many tasks. Null key parts match null. Copies without any arrival number
    cannot be told apart and are no repeats.
    """
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*key, seq])]).alias("_k")
    firsts = df.groupBy(*key).agg(F.min(seq).alias(seq)).select(place, F.lit(False).alias("repeat"))
    return df.select("*", place).join(firsts, "_k", "left").select(
        *df.columns, F.coalesce("repeat", F.lit(True)).alias("repeat")
    )


def distinct_keys(df: DataFrame, key: Sequence[str] = TICK_KEY) -> DataFrame:
    return df.select(*key).distinct()


def balance(batches: DataFrame) -> DataFrame:
    """Totals of a batch log and the rule received - processed = cache + db.

    A batch row has ``batch_size``, ``cached`` (removed before the write) and ``inserted``;
    the write itself removed the rest.
    """
    return batches.agg(
        F.sum("batch_size").alias("received"),
        F.sum("inserted").alias("processed"),
        F.sum("cached").alias("dedup_cache"),
        F.sum(F.col("batch_size") - F.col("cached") - F.col("inserted")).alias("dedup_db"),
    ).withColumn(
        "balanced",
        F.col("received") - F.col("processed") == F.col("dedup_cache") + F.col("dedup_db"),
    )


def shares(totals: DataFrame) -> DataFrame:
    """Share of each removal level, of all received and of all removed, in percent."""
    removed = F.col("dedup_cache") + F.col("dedup_db")
    level = F.explode(
        F.array(
            F.struct(F.lit("cache").alias("level"), F.col("dedup_cache").alias("removed")),
            F.struct(F.lit("db").alias("level"), F.col("dedup_db").alias("removed")),
            F.struct(F.lit("total").alias("level"), removed.alias("removed")),
        )
    )
    return totals.select("received", removed.alias("_all"), level.alias("l")).select(
        "l.level",
        "l.removed",
        F.when(F.col("received") > 0, F.col("l.removed") * 100.0 / F.col("received")).alias("pct_of_received"),
        F.when(F.col("_all") > 0, F.col("l.removed") * 100.0 / F.col("_all")).alias("pct_of_removed"),
    )
