"""Partial candles in tiers: batches add small files, tiers of them are merged, readers see one state throughout.

A batch commits its partial candles as tier 0. As soon as a day has ``fan`` entries of a tier, they are merged into
one of the next, so a day of n batches has at most ``(fan - 1) * log(n) / log(fan)`` entries, however late its
ticks come. Days that are over are merged into a single entry. A merge writes its files first and then commits
once, new entry in and old ones out; if it dies between the two, nothing has changed and it is done again.
A replayed batch is known by its mark.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ticklake import files, versions
from ticklake.operators.candles import merge_partials, ohlcv
from ticklake.schemas import PARTIAL_CANDLE
from ticklake.session import adaptive
from ticklake.sinks.candles import NO_STREAM
from ticklake.versions import Entry, Version

FAN = 8
PARTIAL = StructType([f for f in PARTIAL_CANDLE.fields if f.name not in ("stream", "batch_id")])


def _tier(number: int) -> str:
    return f"tier{number}"


def _tiers(version: Version) -> list[int]:
    return sorted({int(e.kind[4:]) for e in version.entries if e.kind.startswith("tier")})


def add(candles: DataFrame, batch_id: int, path: str, stream: str = NO_STREAM) -> None:
    """Commit the candles of one batch; a batch that is there already adds nothing."""
    spark = candles.sparkSession
    if versions.latest(spark, path).written(stream, batch_id):
        return
    commit, days = versions.write(_stored(candles), path)

    def attempt(base: Version) -> Version:
        if base.written(stream, batch_id):
            return base
        entries = [Entry(commit, d, _tier(0), base.number + 1) for d in days]
        return versions.commit(spark, path, base, entries, mark=(stream, batch_id, commit))

    versions.retried(spark, path, attempt)


def compact(spark: SparkSession, path: str, fan: int = FAN, closed_before: date | None = None, between=lambda: None) -> int:
    """Merge full tiers, lowest first, and all of the days before ``closed_before``; return the merges done.

    One merge takes all days that are due at a tier. ``between`` runs after its files are written, before its commit.
    """
    done = 0
    while True:
        base = versions.latest(spark, path)
        due, tier = _due(base, fan, closed_before)
        if not due:
            return done
        merged = merge_partials(versions.frame(spark, path, due, PARTIAL))
        commit, days = versions.write(_stored(merged), path)
        between()
        made = [Entry(commit, d, _tier(tier + 1), base.number) for d in days]
        done += versions.replaced(spark, path, base, made, due) is not None


def _due(version: Version, fan: int, closed_before: date | None) -> tuple[list[Entry], int]:
    """(entries to merge, their highest tier): of the days that are over, else of the lowest full tier."""
    tiers = _tiers(version)
    by_day: dict[str, list[Entry]] = {}
    for e in version.of([_tier(t) for t in tiers]):
        by_day.setdefault(e.day, []).append(e)
    if closed_before is not None:
        over = [e for d, held in by_day.items() if len(held) > 1 and d < closed_before.isoformat() for e in held]
        if over:
            return over, max(tiers)
    for t in tiers:
        full = [held for day in by_day.values() if len(held := [e for e in day if e.kind == _tier(t)]) >= max(fan, 2)]
        if full:
            return [e for held in full for e in held], t
    return [], 0


def _stored(candles: DataFrame) -> DataFrame:
    """Candles as they lie in files; a sum of volumes has the type of a volume again."""
    rows = candles.withColumn("dt", F.to_date("start_time"))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PARTIAL.fields]).hint("rebalance", F.col("dt"))


def read(
    spark: SparkSession, path: str, first: date | None = None, last: date | None = None, version: Version | None = None
) -> DataFrame:
    """Merged candles, of the days from ``first`` to ``last`` (inclusive) if given."""
    version = versions.latest(spark, path) if version is None else version
    wanted = [
        e
        for e in version.of([_tier(t) for t in _tiers(version)])
        if (first is None or e.day >= first.isoformat()) and (last is None or e.day <= last.isoformat())
    ]
    return merge_partials(versions.frame(spark, path, wanted, PARTIAL))


def entries_per_day(version: Version) -> dict[str, int]:
    """What a read of each day opens."""
    out: dict[str, int] = {}
    for e in version.of([_tier(t) for t in _tiers(version)]):
        out[e.day] = out.get(e.day, 0) + 1
    return out


def write_stream(
    ticks: DataFrame, interval_s: int, path: str, checkpoint: str, fan: int = FAN, trigger: dict | None = None
) -> StreamingQuery:
    """Candles of a stream without a lateness limit; each batch adds its own and merges the tiers it filled."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with adaptive(spark):
            add(ohlcv(batch, interval_s), batch_id, path, files.stream_id(spark, checkpoint))
            compact(spark, path, fan)

    return (
        ticks.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
