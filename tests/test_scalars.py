import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ticklake.functions import scalars as s
from ticklake.functions import sql as sqlf


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,expected",
    [
        ("12345.67890123456", "12345.67890123"),
        ("999.12345678", "999.12345678"),
        ("99999999999.99999999", "9999999999.99999999"),
        ("-99999999999.99999999", "-9999999999.99999999"),
        ("-1.999999999", "-1.99999999"),
        ("9999999999.999999999", "9999999999.99999999"),
        ("0", "0E-8"),
    ],
)
def test_truncate(spark, text, expected):
    value = F.lit(text).cast("decimal(38,14)")
    assert one(spark, s.truncate_price(value)) == Decimal(expected)
    sqlf.register(spark)
    row = spark.sql(f"SELECT tick_truncate(CAST('{text}' AS DECIMAL(38,14))) AS x").first()
    assert row.x == Decimal(expected)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("1000.50", "1000.5"),
        (" 0.5 ", "0.5"),
        ("1,234.5", "1234.5"),
        ("-7", "-7"),
        ("+7", "7"),
        ("5-", "-5"),
        (".5", "0.5"),
        ("5.", "5"),
        ("1.999999999999", "1.99999999"),
        ("-1.999999999999", "-1.99999999"),
        ("1e3", "0"),
        ("", "0"),
        (".", "0"),
        ("+-5", "0"),
        ("-5-", "0"),
        ("=5", "0"),
        ("1.2.3", "0"),
        (",5", "0"),
        ("NaN", "0"),
        ("79228162514264337593543950335", "79228162514264337593543950335"),
        ("79228162514264337593543950336", "0"),
        ("9" * 60, "0"),
        ("0" * 250 + "5", "5"),
        ("0" * 250 + "5.25-", "-5.25"),
    ],
)
def test_parse_decimal(spark, text, expected):
    assert one(spark, s.parse_decimal(F.lit(text))) == Decimal(expected)
    sqlf.register(spark)
    row = spark.createDataFrame([(text,)], "t string").selectExpr("tick_parse_decimal(t) AS x").first()
    assert row.x == Decimal(expected)


def test_parse_decimal_default(spark):
    missing = F.lit(None).cast("decimal(38,8)")
    assert one(spark, s.parse_decimal(F.lit("x"), missing)) is None
    assert one(spark, s.parse_decimal(F.lit(None).cast("string"))) == 0


def test_millis(spark):
    assert one(spark, s.millis_to_ts(F.lit(1609459200000))) == datetime(2021, 1, 1)
    assert one(spark, s.millis_to_ts(F.lit(None).cast("bigint"))) == datetime(1970, 1, 1)


@pytest.mark.parametrize("step", [1, 7, 30, 60, 90, 2700, 3600, 86400, 100000])
def test_bucket_counts_from_year_one(spark, step):
    ts = datetime(2024, 3, 5, 12, 34, 17, 250000)
    since = int((ts - datetime(1, 1, 1)).total_seconds())
    expected = since // step * step
    got = one(spark, s.bucket_start(F.lit(ts), step))
    assert int((got - datetime(1, 1, 1)).total_seconds()) == expected
    df = spark.createDataFrame([(ts,)], "ts timestamp")
    assert df.groupBy(s.bucket_window(F.col("ts"), step).alias("w")).count().first().w.start == got


@pytest.mark.parametrize("seconds,label", [(30, "30s"), (60, "1m"), (90, "90s"), (120, "2m"), (3600, "60m"), (1, "1s")])
def test_interval_label(spark, seconds, label):
    assert one(spark, s.interval_label(seconds)) == label
    sqlf.register(spark)
    assert spark.sql(f"SELECT tick_interval_label({seconds}) AS x").first().x == label


def test_uuid7(spark):
    ts = datetime(2024, 1, 1)
    rows = spark.range(200).select(s.uuid7(F.lit(ts)).alias("u")).collect()
    assert len({r.u for r in rows}) == 200
    for r in rows:
        assert re.match(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", r.u)
        assert int(r.u.replace("-", "")[:12], 16) == int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)


def wrapped_hash(text):
    units, h = text.encode("utf-16-le"), 17
    for low, high in zip(units[::2], units[1::2]):
        h = (h * 31 + low + 256 * high) & 0xFFFFFFFF
    return h & 0x7FFFFFFF


@pytest.mark.parametrize("text", ["BTCUSDT", "ETHUSDT", "SOLUSDT", "", "a", "Z" * 40, "é\U0001f600x"])
def test_stable_hash(spark, text):
    sqlf.register(spark)
    assert spark.createDataFrame([(text,)], "t string").selectExpr("tick_shard(t, 7) AS x").first().x == wrapped_hash(text) % 7
    assert one(spark, s.stable_hash(F.lit(text))) == wrapped_hash(text)
    assert one(spark, s.shard(F.lit(text), 4)) == wrapped_hash(text) % 4


def test_exchange_tag(spark):
    assert one(spark, s.exchange_tag(F.lit("Binance"))) == "binance"
    assert one(spark, s.exchange_tag(F.lit("binance"), "unknown")) == "unknown"
    assert one(spark, s.exchange_tag(F.lit("binance"), "unknown", ignore_case=True)) == "binance"
    assert one(spark, s.exchange_tag(F.lit("Other"))) == "Other"


def test_partition_names(spark):
    assert one(spark, s.partition_name("rawticks", F.lit(date(2024, 1, 5)))) == "rawticks_2024_01_05"
    assert one(spark, s.partition_day("rawticks", F.lit("rawticks_2024_01_05"))) == date(2024, 1, 5)
    for bad in ("rawticks_default", "rawticks_2024_13_05", "rawticks_2024_1_5", "other_2024_01_05"):
        assert one(spark, s.partition_day("rawticks", F.lit(bad))) is None


def test_labels(spark):
    text = F.lit('exchange="binance",le="+Inf"')
    assert one(spark, s.label_map(text)) == {"exchange": "binance", "le": "+Inf"}
    assert one(spark, s.label_pairs(text)) == "exchange=binance; le=+Inf"
    twice = F.lit('a="1", b="x\\"}\\\\n\\n", a="2"')
    assert one(spark, s.label_map(twice)) == {"a": "2", "b": 'x"}\\n\n'}
    assert one(spark, s.label_map(F.lit(""))) == {}
    long = "v" * 200_000
    assert one(spark, s.label_map(F.lit(f'a="{long}"'))) == {"a": long}


def test_values(spark):
    assert one(spark, s.metric_value(F.lit("1.5e3"))) == 1500.0
    assert one(spark, s.metric_value(F.lit("+Inf"))) == float("inf")
    assert one(spark, s.metric_value(F.lit("x"))) is None
    assert one(spark, s.fill_percent(F.lit(1), F.lit(3))) == 33.3
    assert one(spark, s.fill_percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, s.csv_quote(F.lit('a"b'))) == '"a""b"'
    assert one(spark, s.subscribe_message(F.lit("BTCUSDT"))) == (
        '{"method":"SUBSCRIBE","params":["btcusdt@trade"],"id":1}'
    )
