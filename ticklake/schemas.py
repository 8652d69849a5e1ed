"""Schemas of the tables and messages. Nothing is ever inferred from data."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

PRICE = DecimalType(18, 8)

# The identity of a tick: two trades with the same three values are one tick.
TICK_KEY = ["ticker", "exchange", "ts"]


def _struct(*fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


TICK = _struct(
    ("trade_id", LongType()),
    ("ticker", StringType()),
    ("exchange", StringType()),
    ("price", PRICE),
    ("volume", PRICE),
    ("ts", TimestampType()),
)

RAW_TICK = _struct(
    ("id", StringType()),
    ("trade_id", LongType()),
    ("ticker", StringType()),
    ("exchange", StringType()),
    ("price", PRICE),
    ("volume", PRICE),
    ("ts", TimestampType()),
    ("received_at", TimestampType()),
    ("normalized", BooleanType()),
    ("dt", DateType()),
)

CANDLE = _struct(
    ("id", StringType()),
    ("ticker", StringType()),
    ("exchange", StringType()),
    ("interval", StringType()),
    ("open", PRICE),
    ("high", PRICE),
    ("low", PRICE),
    ("close", PRICE),
    ("volume", PRICE),
    ("start_time", TimestampType()),
    ("end_time", TimestampType()),
    ("created_at", TimestampType()),
)

# Candles of one batch of a stream, before they are merged.
PARTIAL_CANDLE = _struct(
    ("ticker", StringType()),
    ("exchange", StringType()),
    ("interval", StringType()),
    ("open", PRICE),
    ("high", PRICE),
    ("low", PRICE),
    ("close", PRICE),
    ("volume", DecimalType(28, 8)),
    ("start_time", TimestampType()),
    ("end_time", TimestampType()),
    ("ticks", LongType()),
    ("first_seq", LongType()),
    ("last_seq", LongType()),
    ("dt", DateType()),
    ("stream", StringType()),
    ("batch_id", LongType()),
)

CONNECTION_LOG = _struct(
    ("id", StringType()),
    ("exchange", StringType()),
    ("event_type", StringType()),
    ("message", StringType()),
    ("created_at", TimestampType()),
)

# Trade message on the wire. Field names differ only in case, so the parser
# renames them by position (TRADE_FIELDS) right after reading.
TRADE_MESSAGE = _struct(
    ("e", StringType()),
    ("E", LongType()),
    ("s", StringType()),
    ("t", LongType()),
    ("p", StringType()),
    ("q", StringType()),
    ("T", LongType()),
    ("m", BooleanType()),
    ("M", BooleanType()),
)
TRADE_FIELDS = (
    "struct<event:string,event_ms:bigint,symbol:string,trade_id:bigint,price:string,"
    "quantity:string,trade_ms:bigint,buyer_maker:boolean,ignored:boolean>"
)

KRAKEN_TRADE = _struct(
    ("symbol", StringType()),
    ("price", StringType()),
    ("qty", StringType()),
    ("side", StringType()),
    ("trade_id", StringType()),
    ("timestamp", StringType()),
)
KRAKEN_MESSAGE = _struct(("channel", StringType()), ("data", ArrayType(KRAKEN_TRADE)))

CANDLE_MESSAGE = _struct(
    ("ticker", StringType()),
    ("interval", StringType()),
    ("open", DecimalType(38, 14)),
    ("high", DecimalType(38, 14)),
    ("low", DecimalType(38, 14)),
    ("close", DecimalType(38, 14)),
    ("volume", DecimalType(38, 14)),
    ("startTime", TimestampType()),
    ("endTime", TimestampType()),
    ("exchange", StringType()),
)

# Column order and capitals are those of the metric CSV files.
METRIC_CSV = _struct(
    ("Timestamp", StringType()),
    ("Metric", StringType()),
    ("Labels", StringType()),
    ("Type", StringType()),
    ("Value", StringType()),
    ("Description", StringType()),
)

RUN_RESULT = _struct(
    ("method", StringType()),
    ("mode", StringType()),
    ("chunk_size", IntegerType()),
    ("total_ticks", LongType()),
    ("chunks", IntegerType()),
    ("elapsed_ms", DoubleType()),
    ("ticks_per_sec", DoubleType()),
)


def ddl(name: str, schema: StructType, path: str, partitions: tuple[str, ...] = ()) -> str:
    """CREATE TABLE statement for one of the schemas (parquet, external)."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by} LOCATION '{path}'"


def create_tables(spark, base: str, database: str = "default") -> None:
    """Create the three tables under ``base``: ticks by day, candles by day, connection log."""
    candle = StructType(CANDLE.fields + [StructField("dt", DateType(), True)])
    spark.sql(ddl(f"{database}.rawticks", RAW_TICK, f"{base}/rawticks", ("dt",)))
    spark.sql(ddl(f"{database}.candles", candle, f"{base}/candles", ("dt",)))
    spark.sql(ddl(f"{database}.connectionlogs", CONNECTION_LOG, f"{base}/connectionlogs"))
