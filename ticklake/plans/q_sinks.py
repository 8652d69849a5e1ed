"""Writes, read back from the shared scratch folder, and table maintenance."""

from datetime import date

from pyspark.sql import functions as F

from ticklake.operators import candles, dedup
from ticklake.plans import views as v
from ticklake.plans.q_reads import CANDLE_SQL
from ticklake.plans.registry import query
from ticklake.session import scratch
from ticklake.sinks import candles as candle_sink
from ticklake.sinks import maintenance, ticks
from ticklake.sources import tables

_OUT = "trade_id, ticker, exchange, cast(price as double) as price, cast(volume as double) as volume, ts"

# The table first holds the last arrival of every CLICK and VIEW key; inserting all arrivals must
# keep those and add the first arrival of every other key.
_INSERTED = v.AR + """, st as (
    select ticker, exchange, ts, max(trade_id) as trade_id, max_by(price, trade_id) as price,
           max_by(volume, trade_id) as volume from ar where ticker in ('CLICK', 'VIEW') group by all),
  nw as (
    select ticker, exchange, ts, min(trade_id) as trade_id, min_by(price, trade_id) as price,
           min_by(volume, trade_id) as volume from ar where ticker not in ('CLICK', 'VIEW') group by all)"""
_BOTH = _INSERTED + f"select {_OUT} from st union all by name select {_OUT} from nw"


def _stored(spark, d, label):
    path = scratch(spark, label)
    ar = v.arrivals(spark, d).where(F.col("ticker").isin("CLICK", "VIEW"))
    last = ar.groupBy("ticker", "exchange", "ts").agg(
        F.max("trade_id").alias("trade_id"),
        F.max_by("price", "trade_id").alias("price"),
        F.max_by("volume", "trade_id").alias("volume"),
    )
    ticks.bulk_append(spark, last, path, strict=True)
    return path


def _rows(spark, path):
    return tables.read_ticks(spark, path).select("trade_id", "ticker", "exchange", "price", "volume", "ts")


@query("snk01_insert_ignore", _BOTH)
def snk01(spark, d):
    path = _stored(spark, d, "snk01")
    ticks.insert_ignore(spark, v.arrivals(spark, d), path)
    return _rows(spark, path)


@query("snk01_insert_twice", _INSERTED + "select count(*) as first, 0 as second from nw")
def snk01_twice(spark, d):
    path = _stored(spark, d, "snk01-twice")
    first = ticks.insert_ignore(spark, v.arrivals(spark, d), path)
    second = ticks.insert_ignore(spark, v.arrivals(spark, d), path)
    return spark.range(1).select(F.lit(first).cast("bigint").alias("first"), F.lit(second).alias("second"))


@query("snk02_insert_ignore_text", _BOTH)
def snk02(spark, d):
    path = _stored(spark, d, "snk02")
    entities = v.arrivals(spark, d).withColumn("price", F.col("price").cast("string")).withColumn(
        "volume", F.col("volume").cast("string")
    )
    ticks.insert_ignore_text(spark, entities, path)
    return _rows(spark, path)


@query("snk03_insert_ignore_values", _BOTH)
def snk03(spark, d):
    path = _stored(spark, d, "snk03")
    ticks.insert_ignore_values(spark, v.arrivals(spark, d), path)
    return _rows(spark, path)


@query("snk04_bulk_append", v.TK + f"select {_OUT} from tk union all select {_OUT} from tk")
def snk04(spark, d):
    path = scratch(spark, "snk04")
    ticks.bulk_append(spark, v.ticks(spark, d), path)
    ticks.bulk_append(spark, v.ticks(spark, d), path)
    return _rows(spark, path)


@query(
    "snk05_staged_count",
    _INSERTED + "select (select count(*) from nw) as inserted, (select count(*) from st) + (select count(*) from nw) as stored",
)
def snk05(spark, d):
    path = _stored(spark, d, "snk05")
    inserted = ticks.staged_insert(spark, v.arrivals(spark, d), path)
    return tables.read_ticks(spark, path).agg(F.count("*").alias("stored")).select(
        F.lit(inserted).cast("bigint").alias("inserted"), "stored"
    )


_CANDLE_ROWS = """select ticker, exchange, "interval", cast(open as double) as open, cast(high as double) as high,
  cast(low as double) as low, cast(close as double) as close, cast(volume as double) as volume,
  start_time, end_time, cast(cast(start_time as date) as varchar) as dt from cd"""


@query("snk06_candle_append", v.TK + CANDLE_SQL + _CANDLE_ROWS)
def snk06(spark, d):
    path = scratch(spark, "snk06")
    candle_sink.append(candles.ohlcv(v.ticks(spark, d), 3600), path)
    return tables.read_candles(spark, path).drop("id", "created_at")


_BODY = ("ticker", "interval", "open", "high", "low", "close", "volume", "startTime", "endTime", "exchange")
_KEYS = v.TK + CANDLE_SQL + """select ticker || ':' || exchange as key, ticker, "interval", cast(open as double) as open,
  cast(high as double) as high, cast(low as double) as low, cast(close as double) as close,
  cast(volume as double) as volume, start_time, end_time, exchange, 'application/json' as content_type from cd"""


@query("snk07_candle_messages", _KEYS)
def snk07(spark, d):
    from ticklake.sources.candle_topic import encode

    m = encode(candles.ohlcv(v.ticks(spark, d), 3600))
    body = F.json_tuple("value", *_BODY).alias(*_BODY)
    sent = m.select("key", F.decode(F.col("headers")[0]["value"], "UTF-8").alias("content_type"), body)
    numbers = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    times = [F.col(c).cast("timestamp").alias(n) for c, n in (("startTime", "start_time"), ("endTime", "end_time"))]
    return sent.select("key", "ticker", "interval", *numbers, *times, "exchange", "content_type")


@query("snk08_publish_fallback", v.TK + CANDLE_SQL + _CANDLE_ROWS)
def snk08(spark, d):
    # The publisher fails after the first half of the work; the table must hold every candle once.
    def broker_down(df, batch_id, stream):
        raise ConnectionError("no broker")

    path = scratch(spark, "snk08")
    sink = candle_sink.with_fallback(broker_down, path)
    c = candles.ohlcv(v.ticks(spark, d), 3600)
    sink(c, 0)
    sink(c, 0)
    return tables.read_candles(spark, path).drop("id", "created_at")


@query("udf03_candle_sink", v.TK + CANDLE_SQL + "select ticker, count(*) as candles from cd group by 1")
def udf03(spark, d):
    path = scratch(spark, "udf03")

    def mine(df, batch_id, stream):
        df.groupBy("ticker").agg(F.count("*").alias("candles")).write.mode("overwrite").parquet(path)

    candle_sink.with_fallback(mine, scratch(spark, "unused"))(candles.ohlcv(v.ticks(spark, d), 3600), 0)
    return spark.read.parquet(path)


@query(
    "snk09_connection_log",
    v.LOG
    + """select exchange, status as event_type, case status when 'Connected' then 'Connected to ' || exchange
      when 'Disconnected' then 'Disconnected from ' || exchange else coalesce(message, 'Error on ' || exchange)
      end as message, ts as created_at from lg""",
)
def snk09(spark, d):
    path = scratch(spark, "snk09")
    candle_sink.append_connection_log(v.status_log(spark, d), path, F.col("ts"))
    return tables.read_connection_log(spark, path).drop("id")


@query("snk12_truncate", v.TK + "select count(*) as before, 0 as after from tk")
def snk12(spark, d):
    path = scratch(spark, "snk12")
    ticks.bulk_append(spark, v.ticks(spark, d), path)
    before = tables.read_ticks(spark, path).count()
    ticks.truncate(spark, path)
    return tables.read_ticks(spark, path).agg(
        F.lit(before).cast("bigint").alias("before"), F.count("*").cast("int").alias("after")
    )


@query(
    "snk13_row_edits",
    v.FIRST
    + """select trade_id, ticker, exchange, cast(case when ticker = 'VIEW' then price + 1 else price end as double)
      as price, ts, ticker in ('VIEW', 'CLICK') as normalized from fa where ticker <> 'ERROR'""",
)
def snk13(spark, d):
    path = scratch(spark, "snk13")
    ar = v.arrivals(spark, d)
    ticks.insert_ignore(spark, ar, path)
    stored = dedup.first_arrival(ar)
    ticks.delete_rows(spark, path, stored.where("ticker = 'ERROR'"))
    ticks.update_rows(
        spark, path, stored.where("ticker = 'VIEW'").withColumn("price", F.col("price") + 1), ["price"]
    )
    ticks.mark_normalized(spark, path, stored.where("ticker in ('VIEW', 'CLICK')"))
    return tables.read_ticks(spark, path).select("trade_id", "ticker", "exchange", "price", "ts", "normalized")


@query(
    "snk14_day_partitions",
    v.TK
    + """select case when ticker = 'ERROR' then null else cast(cast(ts as date) as varchar) end as dt, count(*) as rows
    from tk group by 1""",
)
def snk14(spark, d):
    # Rows without a time land in the default partition instead of being refused.
    path = scratch(spark, "snk14")
    t = v.ticks(spark, d).withColumn("ts", F.when(F.col("ticker") != "ERROR", F.col("ts")))
    ticks.append(ticks.to_rows(t), path)
    return maintenance.partition_rows(tables.read_ticks(spark, path))


@query(
    "mnt01_retention",
    v.TK
    + """select cast(cast(ts as date) as varchar) as dt, count(*) as rows from tk
    where cast(ts as date) >= date '2024-01-16' group by 1""",
)
def mnt01(spark, d):
    path = scratch(spark, "mnt01")
    ticks.append(ticks.to_rows(v.ticks(spark, d)), path)
    maintenance.maintain(spark, path, date(2024, 1, 26), 10)
    return maintenance.partition_rows(tables.read_ticks(spark, path))


@query(
    "mnt01_retention_dry_run",
    v.TK + "select distinct cast(cast(ts as date) as varchar) as dt from tk where cast(ts as date) < date '2024-01-16'",
)
def mnt01_dry(spark, d):
    path = scratch(spark, "mnt01-dry")
    ticks.append(ticks.to_rows(v.ticks(spark, d)), path)
    old = maintenance.expired(spark, path, date(2024, 1, 26), 10)
    return spark.createDataFrame([(name,) for name in old], "dt string")


@query("mnt02_partitions", v.TK + "select cast(cast(ts as date) as varchar) as dt, count(*) as rows from tk group by 1")
def mnt02(spark, d):
    path = scratch(spark, "mnt02")
    ticks.append(ticks.to_rows(v.ticks(spark, d)), path)
    return maintenance.partition_rows(tables.read_ticks(spark, path))


@query(
    "mnt03_partition_guard",
    v.TK + "select true as partitioned, false as flat, false as missing, count(*) as rows from tk",
)
def mnt03(spark, d):
    by_day, flat = scratch(spark, "mnt03-day"), scratch(spark, "mnt03-flat")
    rows = ticks.to_rows(v.ticks(spark, d))
    ticks.append(rows, by_day)
    rows.write.parquet(flat)
    assert maintenance.maintain(spark, flat, date(2030, 1, 1), 1)["skipped"]
    return spark.read.parquet(flat).agg(
        F.lit(maintenance.is_partitioned(spark, by_day)).alias("partitioned"),
        F.lit(maintenance.is_partitioned(spark, flat)).alias("flat"),
        F.lit(maintenance.is_partitioned(spark, flat + "-none")).alias("missing"),
        F.count("*").alias("rows"),
    )


@query(
    "mnt04_convert_to_partitioned",
    v.TK + "select cast(cast(ts as date) as varchar) as dt, ticker, count(*) as rows from tk group by 1, 2",
)
def mnt04(spark, d):
    path = scratch(spark, "mnt04")
    ticks.to_rows(v.ticks(spark, d)).drop("dt").write.parquet(path)
    maintenance.convert_to_partitioned(spark, path)
    assert maintenance.is_partitioned(spark, path)
    return spark.read.parquet(path).groupBy("dt", "ticker").agg(F.count("*").alias("rows"))


@query("set02_copy_table", v.TK + f"select {_OUT} from tk")
def set02(spark, d):
    source, target = scratch(spark, "set02-a"), scratch(spark, "set02-b")
    t = v.ticks(spark, d)
    ticks.append(ticks.to_rows(t.where("ticker = 'VIEW'")), target)
    ticks.append(ticks.to_rows(t.where("ticker <> 'VIEW'")), source)
    maintenance.copy_table(spark, tables.read_ticks(spark, source), target)
    return _rows(spark, target)


@query("mnt05_create_tables", v.TK + "select ticker, count(*) as rows from tk group by 1")
def mnt05(spark, d):
    from ticklake.schemas import RAW_TICK, ddl

    # The statement of the tick table, run against data already in place.
    path = scratch(spark, "mnt05")
    ticks.append(ticks.to_rows(v.ticks(spark, d)), path)
    name = "ticklake_" + path.rsplit("-", 1)[1]
    spark.sql(ddl(name, RAW_TICK, path, ("dt",)))
    spark.catalog.recoverPartitions(name)
    try:
        rows = spark.table(name).groupBy("ticker").agg(F.count("*").alias("rows"))
        out = scratch(spark, "mnt05-out")
        rows.write.parquet(out)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.parquet(out)

