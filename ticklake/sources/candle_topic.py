"""Candle messages: encode for a topic, decode from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.functions import message_key, with_once
from ticklake.schemas import CANDLE_MESSAGE

CANDLE_TOPIC = "aggregated-data"
# Candle bounds are whole seconds.
_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def encode(candles: DataFrame, sent_at: Column | None = None) -> DataFrame:
    """Candles as (key, value, headers) rows for the Kafka sink. Prices are JSON numbers."""
    body = F.struct(
        "ticker",
        "interval",
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.date_format("start_time", _SECONDS).alias("startTime"),
        F.date_format("end_time", _SECONDS).alias("endTime"),
        "exchange",
    )
    sent = F.date_format(F.current_timestamp() if sent_at is None else sent_at, _MICROS)
    headers = F.array(
        F.struct(F.lit("content-type").alias("key"), F.encode(F.lit("application/json"), "UTF-8").alias("value")),
        F.struct(F.lit("timestamp").alias("key"), F.encode(sent, "UTF-8").alias("value")),
    )
    return candles.select(
        message_key(F.col("ticker"), F.col("exchange")).alias("key"),
        F.to_json(body).alias("value"),
        headers.alias("headers"),
    )


def decode(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candles, dead letters) of topic rows with a text or binary ``value``."""
    rows = messages.withColumn("value", F.col("value").cast("string"))
    parsed = with_once(rows, "c", F.from_json("value", CANDLE_MESSAGE))
    good = F.col("c.ticker").isNotNull() & F.col("c.interval").isNotNull()
    candles = parsed.where(good).select(
        "c.ticker",
        "c.exchange",
        "c.interval",
        "c.open",
        "c.high",
        "c.low",
        "c.close",
        "c.volume",
        F.col("c.startTime").alias("start_time"),
        F.col("c.endTime").alias("end_time"),
    )
    return candles, parsed.where(F.coalesce(~good, F.lit(True))).drop("c")


def kafka_options(servers: str) -> dict[str, str]:
    """Producer settings: wait for all replicas, no duplicates on retry, compressed."""
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        "kafka.compression.type": "snappy",
    }


def publish(candles: DataFrame, servers: str, topic: str = CANDLE_TOPIC) -> None:
    """Write candles to Kafka (needs Spark's Kafka connector on the class path)."""
    encode(candles).write.format("kafka").options(**kafka_options(servers)).option("topic", topic).option(
        "includeHeaders", "true"
    ).save()


def subscribe(
    spark: SparkSession, servers: str, topic: str = CANDLE_TOPIC, max_offsets: int | None = None
) -> DataFrame:
    """The topic as a stream from its earliest message on; offsets live in the checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()
