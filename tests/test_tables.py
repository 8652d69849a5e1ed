from datetime import date, timedelta
from decimal import Decimal

import pytest
from base import BASE
from pyspark.sql import functions as F

from ticklake.operators import reads
from ticklake.schemas import create_tables
from ticklake.sinks import candles as candle_sink
from ticklake import files
from ticklake.sinks import maintenance, ticks
from ticklake.sources.tables import read_ticks

DAY = 86400


@pytest.fixture
def rows():
    return [
        ("BTCUSDT", 1, 1, 0, "Binance"),
        ("BTCUSDT", 2, 1, DAY, "Binance"),
        ("BTCUSDT", 3, 1, 2 * DAY, "Binance"),
        ("ETHUSDT", 4, 1, 2 * DAY, "Kraken"),
    ]


def test_insert_ignore(spark, make_ticks, folder, rows):
    path = folder()
    assert ticks.insert_ignore(spark, make_ticks(rows), path) == 4
    assert ticks.insert_ignore(spark, make_ticks(rows), path) == 0
    changed = [(t, p + 100, v, s, x) for t, p, v, s, x in rows] + [("SOLUSDT", 9, 1, 0, "Binance")]
    assert ticks.insert_ignore(spark, make_ticks(changed + changed), path) == 1
    table = read_ticks(spark, path)
    assert table.count() == 5 and table.agg(F.max("price")).first()[0] == 9
    r = table.where("ticker = 'SOLUSDT'").first()
    assert len(r.id) == 36 and r.normalized is False and r.dt == date(2024, 1, 1)


def test_rows_without_a_key_are_not_inserted(spark, make_ticks, folder, rows):
    t = make_ticks(rows).withColumn("exchange", F.when(F.col("ticker") != "ETHUSDT", F.col("exchange")))
    assert ticks.insert_ignore(spark, t, folder()) == 3
    assert [r.ticker for r in ticks.refused(t).collect()] == ["ETHUSDT"]


def test_text_prices(spark, folder):
    path = folder()
    data = [(1, "A", "B", "1,000.123456789", "oops", BASE)]
    df = spark.createDataFrame(data, "trade_id long, ticker string, exchange string, price string, volume string, ts timestamp")
    ticks.insert_ignore_text(spark, df, path)
    r = read_ticks(spark, path).first()
    assert (r.price, r.volume) == (Decimal("1000.12345678"), Decimal(0))


def test_strict_append(spark, make_ticks, folder, rows):
    path = folder()
    ticks.bulk_append(spark, make_ticks(rows), path, strict=True)
    with pytest.raises(ticks.DuplicateTick):
        ticks.bulk_append(spark, make_ticks(rows[:1]), path, strict=True)
    with pytest.raises(ticks.DuplicateTick):
        ticks.bulk_append(spark, make_ticks(rows[:1] * 2), folder(), strict=True)
    ticks.bulk_append(spark, make_ticks(rows[:1]), path)
    assert read_ticks(spark, path).count() == 5


def test_staged_insert_counts(spark, make_ticks, folder, rows):
    path = folder()
    assert ticks.staged_insert(spark, make_ticks(rows[:2]), path) == 2
    assert ticks.staged_insert(spark, make_ticks(rows), path) == 2


def test_reads(spark, make_ticks, folder, rows):
    path = folder()
    ticks.insert_ignore(spark, make_ticks(list(reversed(rows))), path)
    table = read_ticks(spark, path)
    at = lambda d: BASE + timedelta(days=d)
    prices = lambda df: [int(r.price) for r in df.collect()]
    assert prices(reads.by_ticker(table, "BTCUSDT")) == [1, 2, 3]
    assert prices(reads.by_ticker(table, "BTCUSDT", at(0.5))) == [2, 3]
    assert prices(reads.by_ticker(table, "BTCUSDT", None, at(0.5))) == [1]
    assert prices(reads.by_ticker(table, "BTCUSDT", at(0.5), at(1.5))) == [2]
    assert prices(reads.by_ticker(table, "BTCUSDT", at(1), at(2))) == [2, 3]
    assert prices(reads.ticker_range(table, "BTCUSDT", at(1), at(2))) == [2]
    assert prices(reads.by_exchange(table, "Kraken")) == [4]
    assert prices(reads.newest(table, "BTCUSDT", 2)) == [3, 2]
    assert prices(reads.unnormalized(table, 1)) == [1]
    assert reads.exists(table, "BTCUSDT", "Binance", at(1)) and not reads.exists(table, "BTCUSDT", "Kraken", at(1))
    assert reads.count(table) == 4 and reads.count(table, at(1), at(2)) == 3
    assert reads.count_range(table, "BTCUSDT", at(0), at(2)).first().n == 2
    one = table.first()
    assert reads.by_id(table, one.id).first().trade_id == one.trade_id and reads.by_id(table, "none").isEmpty()
    with pytest.raises(ValueError):
        reads.time_range(table, closed="right")


def test_edits_touch_only_their_days(spark, make_ticks, folder, rows):
    path = folder()
    ticks.insert_ignore(spark, make_ticks(rows), path)

    def untouched():
        day = files.partition_folders(spark, path)["2024-01-01"]
        return sorted(r.path for r in spark.read.format("binaryFile").load(day).select("path").collect())

    before = untouched()
    keys = make_ticks(rows[1:3])
    ticks.mark_normalized(spark, path, keys)
    ticks.update_rows(spark, path, keys.withColumn("price", F.col("price") * 10), ["price"])
    ticks.delete_rows(spark, path, make_ticks(rows[1:2]))
    assert untouched() == before
    out = {(r.ticker, int(r.price), r.normalized) for r in read_ticks(spark, path).collect()}
    assert out == {("BTCUSDT", 1, False), ("BTCUSDT", 30, True), ("ETHUSDT", 4, False)}
    assert maintenance.partitions(spark, path) == ["2024-01-01", "2024-01-03"]


def test_truncate(spark, make_ticks, folder, rows):
    path = folder()
    ticks.insert_ignore(spark, make_ticks(rows), path)
    ticks.truncate(spark, path)
    assert read_ticks(spark, path).count() == 0
    assert ticks.insert_ignore(spark, make_ticks(rows), path) == 4


def test_retention(spark, make_ticks, folder, rows):
    path = folder()
    ticks.insert_ignore(spark, make_ticks(rows), path)
    today = date(2024, 1, 5)
    assert maintenance.expired(spark, path, today, 3) == ["2024-01-01"]
    assert maintenance.expired(spark, path, today, 0) == []
    assert maintenance.drop_expired(spark, path, today, 2) == []
    assert maintenance.drop_expired(spark, path, today, 2, allow_drop=True) == ["2024-01-01", "2024-01-02"]
    assert maintenance.partitions(spark, path) == ["2024-01-03"]
    missing = path + "-none"
    assert maintenance.maintain(spark, missing, today, 1) == {"dropped": [], "skipped": [missing]}


def test_convert_and_copy(spark, make_ticks, folder, rows):
    flat, target = folder(), folder()
    ticks.to_rows(make_ticks(rows)).drop("dt").write.parquet(flat)
    assert not maintenance.is_partitioned(spark, flat)
    maintenance.convert_to_partitioned(spark, flat)
    assert maintenance.is_partitioned(spark, flat) and files.exists(spark, flat + "__before")
    maintenance.copy_table(spark, read_ticks(spark, flat), target)
    maintenance.copy_table(spark, read_ticks(spark, flat), target)
    assert read_ticks(spark, target).count() == 8


def test_create_tables(spark, folder):
    base = folder("ddl")
    create_tables(spark, base)
    try:
        assert [c.name for c in spark.catalog.listColumns("rawticks") if c.isPartition] == ["dt"]
        assert spark.table("connectionlogs").columns == ["id", "exchange", "event_type", "message", "created_at"]
        assert "interval" in spark.table("candles").columns
    finally:
        for t in ("rawticks", "candles", "connectionlogs"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_fallback_only_on_failure(spark, make_ticks, folder, rows):
    from ticklake.operators.candles import ohlcv

    c, seen, errors = ohlcv(make_ticks(rows), 60), [], []
    path = folder("fallback")
    candle_sink.with_fallback(lambda df, n, stream: seen.append(df.count()), path)(c, 1)
    assert seen == [4] and not files.exists(spark, path)

    def down(df, n, stream):
        raise ConnectionError("no broker")

    sink = candle_sink.with_fallback(down, path, errors.append)
    sink(c, 1)
    sink(c, 1)
    from ticklake.sources.tables import read_candles

    stored = read_candles(spark, path)
    assert len(errors) == 2 and stored.count() == 4 and stored.select("id").distinct().count() == 4
    sink(c, 2)
    assert stored.sparkSession.read.schema(stored.schema).parquet(path).count() == 8


def test_repeated_edits_are_refused(spark, make_ticks, folder, rows):
    from ticklake.sinks import ticks as t

    path = folder("edits")
    t.bulk_append(spark, make_ticks(rows), path)
    keys = make_ticks(rows).select("ticker", "exchange", "ts").limit(1)
    edits = keys.union(keys).selectExpr("*", "true as normalized")
    with pytest.raises(ValueError):
        t.update_rows(spark, path, edits, ["normalized"])
