from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from base import BASE
from pyspark.sql import functions as F

from ticklake.operators import candles
from ticklake.sources import candle_topic


def test_one_minute(make_ticks):
    ticks = make_ticks(
        [
            ("BTCUSDT", 50000, 1.0, 0, "Binance"),
            ("BTCUSDT", 50100, 0.5, 5, "Binance"),
            ("BTCUSDT", 49900, 0.3, 10, "Binance"),
            ("BTCUSDT", 50050, 0.7, 15, "Binance"),
        ]
    )
    (c,) = candles.ohlcv(ticks, 60).collect()
    assert (c.interval, c.open, c.high, c.low, c.close) == ("1m", 50000, 50100, 49900, 50050)
    assert c.volume == Decimal("2.5")


def test_bucket_boundary(make_ticks):
    ticks = make_ticks([("BTCUSDT", 50000, 1, 59, "Binance"), ("BTCUSDT", 50100, 0.5, 60, "Binance")])
    ends = sorted(c.end_time for c in candles.ohlcv(ticks, 60).collect())
    assert ends == [BASE + timedelta(minutes=1), BASE + timedelta(minutes=2)]


def test_volume_is_exact(make_ticks):
    ticks = make_ticks([("BTCUSDT", 1, 0.1, i, "Binance") for i in range(10)])
    assert candles.ohlcv(ticks, 60).first().volume == Decimal("1.0")


def test_exchanges_are_separate(make_ticks):
    ticks = make_ticks([("BTCUSDT", 1, 1.0, 0, "Binance"), ("BTCUSDT", 1, 0.5, 0, "Kraken")])
    assert {(c.exchange, c.volume) for c in candles.ohlcv(ticks, 60).collect()} == {
        ("Binance", Decimal("1.0")),
        ("Kraken", Decimal("0.5")),
    }


@pytest.mark.parametrize("step,label", [(30, "30s"), (60, "1m"), (120, "2m")])
def test_intervals(make_ticks, step, label):
    rows = candles.ohlcv(make_ticks([("X", 1, 1, i * step, "Binance") for i in range(3)]), step).collect()
    assert len(rows) == 3 and {r.interval for r in rows} == {label}


def test_open_and_close_follow_arrival_or_event_time(make_ticks):
    ticks = make_ticks([("X", 2, 1, 30, "B"), ("X", 1, 1, 10, "B"), ("X", 3, 1, 20, "B")])
    by_arrival = candles.ohlcv(ticks, 60).first()
    by_time = candles.ohlcv(ticks, 60, order="event_time").first()
    assert (by_arrival.open, by_arrival.close) == (2, 3)
    assert (by_time.open, by_time.close) == (1, 2)
    with pytest.raises(ValueError):
        candles.ohlcv(ticks, 60, order="price")


def test_halves_merge_to_the_whole(spark, make_ticks):
    rows = [("T%d" % (i % 3), 100 + (i * 37) % 50, 1, i * 7, "B") for i in range(300)]
    ticks = make_ticks(rows)
    whole = candles.ohlcv(ticks, 300)
    halves = candles.ohlcv(ticks.where("trade_id % 2 = 0"), 300).unionByName(
        candles.ohlcv(ticks.where("trade_id % 2 = 1"), 300)
    )
    merged = candles.merge_partials(halves)
    assert whole.exceptAll(merged).isEmpty() and merged.exceptAll(whole).isEmpty()
    coarse, direct = candles.coarsen(candles.ohlcv(ticks, 60), 600), candles.ohlcv(ticks, 600)
    assert coarse.exceptAll(direct).isEmpty() and direct.exceptAll(coarse).isEmpty()


def test_violations(spark):
    good = ("A", 2.0, 3.0, 1.0, 2.0, 1.0)
    bad = ("B", 5.0, 3.0, 4.0, 2.0, 0.0)
    df = spark.createDataFrame([good, bad], "ticker string, open double, high double, low double, close double, volume double")
    (row,) = candles.violations(df).collect()
    assert row.ticker == "B"
    assert set(row.broken.split(",")) == {"high_below_open", "high_below_low", "low_above_close", "no_volume"}


def test_message_round_trip(spark):
    schema = (
        "ticker string, exchange string, interval string, open decimal(18,8), high decimal(18,8), low decimal(18,8),"
        " close decimal(18,8), volume decimal(28,8), start_time timestamp, end_time timestamp"
    )
    start = datetime(2024, 6, 15, 12, 30)
    row = ("solusdt", "binance", "1m", Decimal("150.25"), Decimal("155"), Decimal("148.5"), Decimal("153.75"),
           Decimal("10000"), start, start + timedelta(minutes=1))
    sent = candle_topic.encode(spark.createDataFrame([row], schema))
    m = sent.first()
    assert m.key == "solusdt:binance"
    assert '"open":150.25' in m.value and '"startTime":"2024-06-15T12:30:00Z"' in m.value
    assert m.headers[0].key == "content-type" and bytes(m.headers[0].value) == b"application/json"
    good, bad = candle_topic.decode(sent.select("key", "value"))
    assert bad.isEmpty()
    assert tuple(good.first()) == row
    broken = spark.createDataFrame([("k", "{nope"), ("k", "{}")], "key string, value string")
    good, bad = candle_topic.decode(broken)
    assert good.isEmpty() and bad.count() == 2


def test_rows_are_storable(spark, make_ticks):
    rows = candles.to_rows(candles.ohlcv(make_ticks([("X", 1, 1, 0, "B")]), 60), F.lit(BASE))
    r = rows.first()
    assert r.created_at == BASE and str(r.dt) == "2024-01-01" and len(r.id) == 36
    assert rows.schema["volume"].dataType.simpleString() == "decimal(18,8)"
