"""Joins against lookup tables and key sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.schemas import TICK_KEY



def lookup(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 0
) -> DataFrame:
    """Join each left row to its entry in ``right``, which has one row per key.

    No side is forced: adaptive execution broadcasts ``right`` when its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise splits partitions that a hot left
    key has made too large. ``salts`` spreads the left keys over that many parts by hand, with
    each right row repeated once per part, where adaptive execution is not at work (streams).
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup keeps left rows: 'inner' or 'left'")
    if not salts:
        return left.join(right, list(on), how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


#: Values that are named one by one in a scan; a longer list would only slow the filter down.
NAMED = 500


@dataclass(frozen=True)
class Extent:
    """What part of a table can hold the keys of a batch: a range of time and, while they are few, single values."""

    low: datetime | None
    high: datetime | None
    names: list | None = None
    instants: list | None = None

    def of(self, table: DataFrame, name: str = "ticker", ts: str = "ts") -> DataFrame:
        """The table behind filters that reach its scan: files, row groups and pages elsewhere are not read."""
        if self.low is None:
            return table.where("false")
        out = table.where(F.col(ts).between(F.lit(self.low), F.lit(self.high)))
        if "dt" in table.columns:
            # The session's days: Catalyst derives no partition filter from the time.
            out = out.where(F.col("dt").between(F.to_date(F.lit(self.low)), F.to_date(F.lit(self.high))))
        if self.names is not None:
            out = out.where(F.col(name).isin(self.names))
        return out if self.instants is None else out.where(F.col(ts).isin(self.instants))


def extent(batch: DataFrame, name: str = "ticker", ts: str = "ts") -> Extent:
    """Look at a batch once, and at a very small one twice. At most ``NAMED`` + 1 rows reach the driver."""
    at = F.col(ts).cast("timestamp")
    each = batch.where(at.isNotNull()).groupBy(name).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n"))
    rows = each.limit(NAMED + 1).collect()
    if not rows:
        return Extent(None, None)
    if len(rows) > NAMED:
        low, high = batch.agg(F.min(at), F.max(at)).first()
        return Extent(low, high)
    instants = None
    if sum(r["n"] for r in rows) <= NAMED:
        instants = [r[0] for r in batch.select(at).distinct().collect()]
    return Extent(min(r["low"] for r in rows), max(r["high"] for r in rows), [r[name] for r in rows], instants)


def missing_keys(batch: DataFrame, table: DataFrame, key: Sequence[str] = TICK_KEY) -> DataFrame:
    """Rows of the batch whose key the table does not hold yet.

    The table is first reduced to the keys of the batch. While the batch is small, adaptive
    execution broadcasts its keys there, so the large table is scanned but never shuffled.
    """
    held = table.select(*key).join(batch.select(*key), list(key), "left_semi")
    return batch.join(held, list(key), "left_anti").select(*batch.columns)


def existing_keys(
    table: DataFrame, keys: DataFrame, key: Sequence[str] = TICK_KEY, loose: bool = False
) -> DataFrame:
    """Which of ``keys`` the table holds.

    ``loose`` matches each column on its own list of values, so it also returns stored
    combinations nobody asked for, as three independent IN lists do.
    """
    # The table is reduced to the asked keys before anything is made distinct.
    stored = table.select(*key)
    for on in [[c] for c in key] if loose else [list(key)]:
        stored = stored.join(keys.select(*on).distinct(), on, "left_semi")
    return stored.distinct()


def subscriptions(readers: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Readers with the address of their exchange; readers of unknown exchanges drop out.

    ``{symbol}`` in the address is replaced in any spelling of its letters.
    """
    joined = lookup(readers, exchanges, ["exchange"])
    url = F.regexp_replace("url", F.lit(r"(?i)\{symbol\}"), F.col("symbol"))
    return joined.withColumn("url", url)


def compare_runs(base: DataFrame, other: DataFrame, on: str = "test_name", value: str = "avg_ms") -> DataFrame:
    """Tests present in both runs with base / other as speed-up (0 when the base is 0)."""
    a = base.select(on, F.col(value).alias("base"))
    b = other.select(on, F.col(value).alias("other"))
    return a.join(b, on).withColumn(
        "speedup",
        F.when(F.col("base") > 0, F.try_divide("base", "other")).otherwise(F.lit(0.0)),
    )
