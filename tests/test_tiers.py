"""Partial candles in tiers, and small batches that wait."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from base import BASE

from ticklake import files, versions
from ticklake.operators.candles import merge_partials, ohlcv
from ticklake.schemas import TICK
from ticklake.sinks import candle_tiers as tiers
from ticklake.sinks import versioned as vt
from ticklake.streaming import postponed


def some_ticks(spark, n, first=0, step=30):
    data = [
        (i, "AB"[i % 2], "X", Decimal(100 + (i * 37) % 50), Decimal(i % 7 + 1), BASE + timedelta(seconds=i * step)) for i in range(first, first + n)
    ]
    return spark.createDataFrame(data, TICK)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_candles_are_the_same_before_during_and_after(spark, folder):
    path, batches = folder(), 9
    for b in range(batches):
        tiers.add(ohlcv(some_ticks(spark, 40, b * 40), 3600), b, path, "s")
    want = rows(merge_partials(ohlcv(some_ticks(spark, 40 * batches), 3600)))
    assert rows(tiers.read(spark, path)) == want

    class Killed(Exception):
        pass

    def die():
        assert rows(tiers.read(spark, path)) == want  # files are there, the commit is not
        raise Killed

    before = versions.latest(spark, path)
    with pytest.raises(Killed):
        tiers.compact(spark, path, fan=3, between=die)
    assert versions.latest(spark, path) == before and len(versions.orphans(spark, path)) == 1
    pinned = tiers.read(spark, path)
    seen = []
    done = tiers.compact(spark, path, fan=3, between=lambda: seen.append(rows(tiers.read(spark, path)) == want))
    assert done == 1 and seen == [True]  # a full tier is merged whole
    assert rows(tiers.read(spark, path)) == want == rows(pinned)
    assert max(tiers.entries_per_day(versions.latest(spark, path)).values()) < 3


def test_the_number_of_entries_is_bounded(spark, folder):
    path = folder()
    for b in range(10):
        tiers.add(ohlcv(some_ticks(spark, 4, b * 4), 3600), b, path, "s")
        tiers.compact(spark, path, fan=2)
        assert max(tiers.entries_per_day(versions.latest(spark, path)).values()) <= 4  # log2(10)
    assert rows(tiers.read(spark, path)) == rows(merge_partials(ohlcv(some_ticks(spark, 40), 3600)))
    stored = [spark.read.parquet(f"{path}/{e.folder}").schema["volume"].dataType for e in versions.latest(spark, path).entries]
    assert set(stored) == {tiers.PARTIAL["volume"].dataType}  # however often it was summed


def test_replays_add_nothing_and_days_that_are_over_become_one(spark, folder):
    path = folder()
    for b in range(4):
        for _ in range(2):
            tiers.add(ohlcv(some_ticks(spark, 60, b * 60, step=1000), 3600), b, path, "s")
    want = rows(merge_partials(ohlcv(some_ticks(spark, 240, step=1000), 3600)))
    assert rows(tiers.read(spark, path)) == want
    last = date(2024, 1, 3)
    tiers.compact(spark, path, fan=100, closed_before=last)
    held = tiers.entries_per_day(versions.latest(spark, path))
    assert {n for d, n in held.items() if d < last.isoformat()} == {1} and rows(tiers.read(spark, path)) == want
    # a late batch on a day that is over
    tiers.add(ohlcv(some_ticks(spark, 2, 0), 3600), 0, path, "late")
    assert sum(r.ticks for r in tiers.read(spark, path).collect()) == 242
    one = tiers.read(spark, path, date(2024, 1, 2), date(2024, 1, 2))
    assert {r.start_time.date() for r in one.collect()} == {date(2024, 1, 2)}


def trickle(spark, path, n=12, each=10):
    for b in range(n):
        some_ticks(spark, each, b * each).coalesce(1).write.mode("append").parquet(path)
    files.order_by_name(spark, path)
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_trickle_becomes_few_large_commits(spark, folder):
    path, cp, src = folder(), folder(), folder()
    stream = trickle(spark, src)
    postponed.write_stream(stream, path, cp, rows=50, seconds=1e9).awaitTermination()
    now = versions.latest(spark, path)
    commits = {e.commit for e in now.of(versions.ROWS)}
    assert len(commits) == 2 and vt.read(spark, path).count() == 100
    assert sum(e.rows for e in now.of(postponed.PENDING)) == 20
    assert postponed.flush(spark, path) == 20 and postponed.flush(spark, path) == 0
    assert vt.read(spark, path).count() == 120 == vt.read(spark, path).select("trade_id").distinct().count()


def test_old_batches_are_released(spark, folder):
    path, cp, src = folder(), folder(), folder()
    times = iter(range(0, 1000, 10))
    stream = trickle(spark, src, n=6)
    postponed.write_stream(stream, path, cp, rows=10**9, seconds=25, clock=lambda: next(times)).awaitTermination()
    # batches at 0, 10, 20, 30 are released at 30; those at 40 and 50 wait
    assert vt.read(spark, path).count() == 40
    assert sum(e.rows for e in versions.latest(spark, path).of(postponed.PENDING)) == 20


def test_replays_and_crashes_lose_and_double_nothing(spark, folder):
    path = folder()
    batch = some_ticks(spark, 10)
    for _ in range(2):
        postponed.hold(batch, 0, path, "s", 0)
    postponed.hold(batch.limit(0), 1, path, "s", 0)
    assert sum(e.rows for e in versions.latest(spark, path).of(postponed.PENDING)) == 10

    class Killed(Exception):
        pass

    def die():
        raise Killed

    with pytest.raises(Killed):
        postponed.flush(spark, path, between=die)
    assert vt.read(spark, path).count() == 0
    assert postponed.flush(spark, path) == 10 and vt.read(spark, path).count() == 10
    postponed.hold(some_ticks(spark, 12), 2, path, "s", 0)  # ten of them are there already
    assert postponed.flush(spark, path) == 2 and versions.latest(spark, path).of(postponed.PENDING) == []
