"""Ticks, messages, logs and samples derived from the given tables, each with its SQL twin.

Every view covers its whole table. Arrival order is ``event_id``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.operators import ordered
from ticklake.operators.dedup import mark_repeats
from ticklake.operators.rates import one_per_instant
from ticklake.session import cut

DAY = (datetime(2024, 1, 10), datetime(2024, 1, 11))
HOUR = (datetime(2024, 1, 10, 12), datetime(2024, 1, 10, 13))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_columns(table(spark, sf_dir, "events"))


def tick_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("trade_id"),
        F.upper("event_type").alias("ticker"),
        F.when(F.col("user_id") % 2 == 0, "Binance").otherwise("Kraken").alias("exchange"),
        F.col("value").cast("decimal(18,8)").alias("price"),
        (_k().cast("double") / 100).cast("decimal(18,8)").alias("volume"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


TK = """with tk as (
  select event_id as trade_id, upper(event_type) as ticker,
         case when user_id % 2 = 0 then 'Binance' else 'Kraken' end as exchange,
         cast(value as decimal(18,8)) as price,
         cast(cast(json_extract_string(props, '$.k') as double) / 100 as decimal(18,8)) as volume,
         ts
  from events)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks whose exchange clock shows hours only: keys repeat, with different prices."""
    return ticks(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))


AR = TK + """, ar as (
  select trade_id, ticker, exchange, price, volume, date_trunc('hour', ts) as ts from tk)"""

FIRST = AR + """, fa as (
  select ticker, exchange, ts, min(trade_id) as trade_id,
         min_by(price, trade_id) as price, min_by(volume, trade_id) as volume
  from ar group by all)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire text (seq, value): trades, other events, trades without a symbol, broken text."""
    return message_columns(table(spark, sf_dir, "events"))


def message_columns(events: DataFrame) -> DataFrame:
    ms = F.unix_millis("ts")
    text = F.to_json(
        F.struct(
            F.when(F.col("ticker") == "SIGNUP", "24hrTicker").otherwise("trade").alias("e"),
            ms.alias("E"),
            # A null field is left out of the text.
            F.when((F.col("ticker") != "VIEW") | (F.col("exchange") == "Binance"), F.col("ticker")).alias("s"),
            F.col("trade_id").alias("t"),
            F.when(F.col("ticker") == "VIEW", "bad").otherwise(F.col("price").cast("string")).alias("p"),
            F.col("volume").cast("string").alias("q"),
            ms.alias("T"),
            (F.col("exchange") == "Binance").alias("m"),
            F.lit(True).alias("M"),
        )
    )
    broken = F.concat(F.lit("{broken "), F.col("trade_id").cast("string"))
    return tick_columns(events).select(
        F.col("trade_id").alias("seq"), F.when(F.col("ticker") == "ERROR", broken).otherwise(text).alias("value")
    )


# What the parser must make of them.
MSG = TK + """, parsed as (
  select trade_id as seq, ticker,
         case when ticker = 'ERROR' then 'dead'
              when ticker = 'SIGNUP' or (ticker = 'VIEW' and exchange = 'Kraken') then 'ignored'
              else 'tick' end as status,
         case when ticker = 'ERROR' then 'malformed'
              when ticker = 'SIGNUP' then 'not_a_trade'
              when ticker = 'VIEW' and exchange = 'Kraken' then 'no_symbol' end as reason,
         case when ticker = 'VIEW' then 0 else price end as price, volume,
         date_trunc('milliseconds', ts) as ts
  from tk)"""


def kraken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire text of the second exchange: two trades a message, heartbeats, status messages."""
    t = ticks(spark, sf_dir)
    entry = lambda side: F.struct(
        F.col("ticker").alias("symbol"),
        F.col("price").cast("double").alias("price"),
        F.col("volume").cast("double").alias("qty"),
        F.lit(side).alias("side"),
        F.col("trade_id").alias("trade_id"),
    )
    trade = F.to_json(
        F.struct(F.lit("trade").alias("channel"), F.array(entry("buy"), entry("sell")).alias("data"))
    )
    value = (
        F.when(F.col("ticker") == "ERROR", F.lit('{"channel":"heartbeat"}'))
        .when(F.col("ticker") == "SIGNUP", F.lit('{"channel":"status","data":[]}'))
        .otherwise(trade)
    )
    return t.select(F.col("trade_id").alias("seq"), value.alias("value"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection events (seq, exchange, status, message, ts)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 2 == 0, "Binance").otherwise("Kraken").alias("exchange"),
        F.when(kind.isin("click", "signup"), "Connected")
        .when(kind.isin("view", "purchase"), "Disconnected")
        .otherwise("Error")
        .alias("status"),
        F.when(_k().cast("int") >= 50, F.col("props")).alias("message"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


LOG = """with lg as (
  select event_id as seq, case when user_id % 2 = 0 then 'Binance' else 'Kraken' end as exchange,
         case when event_type in ('click', 'signup') then 'Connected'
              when event_type in ('view', 'purchase') then 'Disconnected' else 'Error' end as status,
         case when cast(json_extract_string(props, '$.k') as integer) >= 50 then props end as message,
         ts
  from events)"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch log: one batch per hour and exchange, with what each level removed."""
    hour = F.floor(F.unix_seconds("ts") / 3600).cast("bigint")
    channel = F.when(F.col("exchange") == "Binance", 0).otherwise(1)
    return (
        mark_repeats(arrivals(spark, sf_dir))
        .groupBy(F.col("ts"), channel.alias("channel"))
        .agg(
            F.count("*").alias("batch_size"),
            F.count_if(F.col("repeat") & (F.col("price") < 50)).alias("cached"),
            F.count_if(~F.col("repeat")).alias("inserted"),
            F.sum("price").alias("duration_ms"),
        )
        .withColumn("batch_id", hour * 2 + F.col("channel"))
    )


BATCH = AR + """, marked as (
  select ar.*, trade_id <> min(trade_id) over (partition by ticker, exchange, ts) as repeat from ar
), bl as (
  select ts, case when exchange = 'Binance' then 0 else 1 end as channel,
         count(*) as batch_size,
         count_if(repeat and price < 50) as cached,
         count_if(not repeat) as inserted,
         sum(price) as duration_ms,
         cast(epoch(ts) as bigint) // 3600 * 2 + case when exchange = 'Binance' then 0 else 1 end as batch_id
  from marked group by ts, exchange)"""


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (metric, exchange, ms, value, ts), one per series and millisecond."""
    t = ticks(spark, sf_dir).select(
        F.lower("ticker").alias("metric"), "exchange", "ts", F.col("price").alias("value")
    )
    return one_per_instant(t, ["metric", "exchange"])


GAUGE = TK + """, ga as (
  select lower(ticker) as metric, exchange, date_trunc('milliseconds', ts) as ts, max(price) as value
  from tk group by all)"""


def health_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline counters per hour and exchange: incoming, received and queued so far."""
    return ordered.running_sum(
        cut(batches(spark, sf_dir)),
        ["channel"],
        "ts",
        {"incoming": F.col("batch_size"), "received": F.col("batch_size") - F.col("cached")},
        ordered.time_chunk("ts", 86400),
    ).select("ts", "channel", "incoming", "received", F.col("inserted").alias("queued"))


HEALTH = BATCH + """, hs as (
  select ts, channel,
         cast(sum(batch_size) over w as bigint) as incoming,
         cast(sum(batch_size - cached) over w as bigint) as received, inserted as queued
  from bl window w as (partition by channel order by ts rows unbounded preceding))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured runs, one per order."""
    o = table(spark, sf_dir, "orders")
    ms = (F.col("o_totalprice").cast("decimal(18,2)"))
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderkey").alias("iteration"),
        F.col("o_orderpriority").alias("test_name"),
        F.col("o_orderpriority").alias("method"),
        F.when(F.col("o_orderstatus") == "O", "Sequential").otherwise("Parallel").alias("mode"),
        F.col("o_orderstatus").alias("label"),
        F.year("o_orderdate").alias("chunk_size"),
        (F.col("o_custkey") + 1).alias("total_ticks"),
        F.col("o_custkey").alias("rows"),
        ms.alias("elapsed_ms"),
        ((F.col("o_custkey") + 1).cast("double") / ms.cast("double") * 1000).alias("ticks_per_sec"),
    )


RUNS = """with rn as (
  select o_orderkey as run_id, o_orderkey as iteration, o_orderpriority as test_name,
         o_orderpriority as method,
         case when o_orderstatus = 'O' then 'Sequential' else 'Parallel' end as mode,
         o_orderstatus as label, cast(year(o_orderdate) as integer) as chunk_size,
         o_custkey + 1 as total_ticks, o_custkey as rows,
         cast(o_totalprice as decimal(18,2)) as elapsed_ms,
         cast(o_custkey + 1 as double) / cast(cast(o_totalprice as decimal(18,2)) as double) * 1000 as ticks_per_sec
  from orders)"""


def scrape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric text (scrape, line_no, line): an hour is a scrape, an event is up to three lines."""
    t = ticks(spark, sf_dir)
    kind, number = F.lower("ticker"), F.col("trade_id").cast("string")
    value = (
        F.when(F.col("volume") == 0, "NaN").when(F.col("volume") == F.lit("0.01").cast("decimal(18,8)"), "+Inf")
        .otherwise(F.col("price").cast("string"))
    )
    name = F.when(kind == "error", "error_ms_bucket").otherwise(F.concat(kind, F.lit("_total")))
    about = F.when(kind == "error", "error_ms").otherwise(name)
    sample = F.concat(name, F.lit('{exchange="'), F.lower("exchange"), F.lit('",id="'), number, F.lit('"} '), value)
    lines = (
        F.when(kind == "signup", F.array(F.concat(F.lit("bad line "), number)))
        .when(kind == "view", F.array(F.lit("# just a remark"), F.lit("  "), sample))
        .otherwise(
            F.array(
                F.concat(F.lit("# HELP "), about, F.lit(" Total of "), number),
                F.concat(F.lit("# TYPE "), about, F.lit(" counter")),
                sample,
            )
        )
    )
    return t.select(
        F.date_trunc("hour", "ts").alias("scrape"),
        F.col("trade_id"),
        F.posexplode(lines).alias("i", "line"),
    ).select("scrape", (F.col("trade_id") * 10 + F.col("i")).alias("line_no"), "line")


SCRAPE = TK + """, sc as (
  select date_trunc('hour', ts) as scrape, trade_id, lower(ticker) as kind,
         case when ticker = 'ERROR' then 'error_ms_bucket' else lower(ticker) || '_total' end as metric,
         'exchange="' || lower(exchange) || '",id="' || trade_id || '"' as labels,
         case when volume = 0 then 'NaN' when volume = 0.01 then 'Inf' else cast(price as varchar) end as value
  from tk)"""
