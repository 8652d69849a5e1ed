"""Streams over the given events, run to their end and read back."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from ticklake.operators import candles
from ticklake.plans import views as v
from ticklake.plans.q_functions import STABLE_HASH
from ticklake.plans.q_reads import CANDLE_OUT, CANDLE_SQL
from ticklake.plans.q_windows import FIFO
from ticklake.plans.registry import query
from ticklake.session import scratch
from ticklake.files import names, order_by_name
from ticklake.sources import messages
from ticklake.sources.tables import read_candles, read_ticks
from ticklake.streaming import candles as sc
from ticklake.streaming import counters
from ticklake.streaming import dedup as sd
from ticklake.streaming.ingest import Ingest, decode_candle_stream, message_stream, trigger

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def split_files(spark, df, label, order, files=4):
    """A folder of files that a stream reads one by one, in the order of ``order``."""
    path = scratch(spark, label)
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    order_by_name(spark, path)
    return path


#: Messages of a file, about.
FILE_ROWS = 250_000


def message_batches(spark, messages, label, batches):
    """Messages that come in so many batches, in order, each of as many files as its rows fill.

    A file is sorted and written by one task, and read by one, so a batch of one file is no faster on more cores.
    """
    share = max(1, -(-messages.count() // (batches * FILE_ROWS)))
    path = split_files(spark, messages, label, "seq", batches * share)
    # Ranges are drawn from a sample, and an empty one gives no file.
    share = max(1, -(-sum(n.endswith(".parquet") for n in names(spark, path)) // batches))
    return message_stream(spark, path, files_per_trigger=share)


def event_stream(spark, d, label):
    path = split_files(spark, v.table(spark, d, "events"), label, "event_id")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def tick_stream(spark, d, label):
    return v.tick_columns(event_stream(spark, d, label))


def arrival_stream(spark, d, label):
    return tick_stream(spark, d, label).withColumn("ts", F.date_trunc("hour", "ts"))


def message_files(spark, d, label):
    return message_batches(spark, v.messages(spark, d), label, 4)


def drain(stream, spark, label, mode="append"):
    """Run a stream to its end into a folder and return what it wrote."""
    out = scratch(spark, label)
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch(spark, label + "-cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("str01_candles_merged", v.TK + CANDLE_SQL + CANDLE_OUT)
def str01(spark, d):
    path = scratch(spark, "str01")
    sc.write_partials(tick_stream(spark, d, "str01-in"), 3600, path, scratch(spark, "str01-cp")).awaitTermination()
    return sc.read_merged(spark, path)


# Files come in order, so nothing is late: out come the candles that end before the last watermark.
@query(
    "str02_closed_candles",
    v.TK + CANDLE_SQL + CANDLE_OUT
    + " where end_time <= (select date_trunc('milliseconds', max(ts)) from tk) - interval 2 hour",
)
def str02(spark, d):
    return drain(sc.closed_candles(tick_stream(spark, d, "str02-in"), 3600, "2 hours"), spark, "str02")


@query(
    "str03_late_rows",
    v.TK + CANDLE_SQL + """, tot as (select ticker, cast(sum(ticks) as bigint) as ticks,
      cast(sum(volume) as double) as volume from cd group by 1) select * from tot""",
)
def str03(spark, d):
    # The events arrive twice over, the second time late: each bucket gets more partial rows,
    # merged volume counts both, so half of it is the volume of the events.
    path = scratch(spark, "str03")
    cp = scratch(spark, "str03-cp")
    e = v.table(spark, d, "events")
    src = scratch(spark, "str03-in")
    for _ in range(2):
        e.write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
        sc.write_partials(v.tick_columns(stream), 3600, path, cp).awaitTermination()
    merged = sc.read_merged(spark, path)
    return merged.groupBy("ticker").agg(
        (F.sum("ticks") / 2).cast("bigint").alias("ticks"), (F.sum("volume") / 2).alias("volume")
    )


@query("str04_final_flush", v.TK + CANDLE_SQL + CANDLE_OUT)
def str04(spark, d):
    # Closed candles of the stream plus the candles still open at its end are all candles.
    out = drain(sc.closed_candles(tick_stream(spark, d, "str04-in"), 3600, "2 hours"), spark, "str04")
    return out.unionByName(sc.open_candles(v.ticks(spark, d), out, 3600))


# Ticks arrive in an order that has nothing to do with their time: most are later than any delay.
_SHUFFLED = 7919
_ARRIVED = f"""trade_id * {_SHUFFLED} % 1000003"""


@query(
    "str05_stream_dedup",
    v.AR
    + f""", sf as (select *, {_ARRIVED} as arrival from ar)
    select ticker, exchange, ts, min(arrival) as trade_id, cast(min_by(price, arrival) as double) as price,
      cast(min_by(volume, arrival) as double) as volume from sf group by 1, 2, 3""",
)
def str05(spark, d):
    late = v.arrivals(spark, d).withColumn("trade_id", F.expr(_ARRIVED))
    src, path = split_files(spark, late, "str05-in", "trade_id"), scratch(spark, "str05")
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sd.first_arrivals(stream, path, scratch(spark, "str05-cp")).awaitTermination()
    return sd.read_first_arrivals(spark, path, late.schema).select(
        "ticker", "exchange", "ts", "trade_id", "price", "volume"
    )


@query("str05_within_watermark", v.FIRST + "select ticker, exchange, ts from fa")
def str05_watermark(spark, d):
    # Files come in order of time, so nothing is late and every key is kept once.
    out = drain(sd.within_watermark(arrival_stream(spark, d, "str05w-in"), "40 days"), spark, "str05w")
    return out.select("ticker", "exchange", "ts")


@contextmanager
def _rocksdb(spark):
    """The session's state store for the time of a stream."""
    before = {key: spark.conf.get(key, None) for key in sd.STATE_STORE}
    for key, value in sd.STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@query("str06_fifo_stream", v.FIRST + "select trade_id, ticker, exchange, ts from fa")
def str06(spark, d):
    # With a memory larger than the stream the filter keeps exactly the first arrivals. The ring lies in the state
    # store; a task holds its part of one batch.
    shards = max(8, -(-v.table(spark, d, "events").count() // 50_000))
    with _rocksdb(spark):
        out = drain(sd.fifo(arrival_stream(spark, d, "str06-in"), size=1 << 30, shards=shards), spark, "str06")
    return out.select("trade_id", "ticker", "exchange", "ts")


@query("str06_fifo_stream_small", FIFO)
def str06_small(spark, d):
    with _rocksdb(spark):
        out = drain(sd.fifo(arrival_stream(spark, d, "str06s-in"), size=3, shards=4, by="ticker"), spark, "str06s")
    return out.select("trade_id", "ticker", "exchange", "ts", "shard")


_INGESTED = v.MSG + """, good as (select * from parsed where status = 'tick')"""


def _ingest(spark, d, label, **options):
    job = Ingest("Binance", scratch(spark, label), 3600, **options)
    job.start(message_files(spark, d, label + "-in"), scratch(spark, label + "-cp")).awaitTermination()
    return job


@query(
    "str07_fan_out_ticks",
    _INGESTED
    + """select seq as trade_id, ticker, 'Binance' as exchange, cast(price as double) as price,
      cast(volume as double) as volume, ts from good""",
)
def str07(spark, d):
    job = _ingest(spark, d, "str07")
    return read_ticks(spark, job.tick_path).select("trade_id", "ticker", "exchange", "price", "volume", "ts")


@query(
    "str07_fan_out_candles",
    _INGESTED
    + """select ticker, time_bucket(interval '1 hour', ts) as start_time, cast(min_by(price, seq) as double) as open,
      cast(max(price) as double) as high, cast(min(price) as double) as low,
      cast(max_by(price, seq) as double) as close, cast(sum(volume) as double) as volume, count(*) as ticks
    from good group by 1, 2""",
)
def str07_candles(spark, d):
    job = _ingest(spark, d, "str07c", candles_from="raw")
    return sc.read_merged(spark, job.candle_path).select(
        "ticker", "start_time", "open", "high", "low", "close", "volume", "ticks"
    )


def _two_feeds(spark, d, label):
    """Two feeds into one base, and the second one read anew by a new checkpoint."""
    base = scratch(spark, label)
    for half in (0, 1, 1):
        part = v.messages(spark, d).where(F.col("seq") % 2 == half)
        src = message_batches(spark, part, f"{label}-in", 2)
        job = Ingest("Binance", base, 3600)
        job.start(src, scratch(spark, f"{label}-cp")).awaitTermination()
    return job


@query(
    "str07_two_feeds_ticks",
    _INGESTED
    + """select seq as trade_id, ticker, cast(price as double) as price, cast(volume as double) as volume, ts
    from good""",
)
def str07_feeds(spark, d):
    job = _two_feeds(spark, d, "str07f")
    return read_ticks(spark, job.tick_path).select("trade_id", "ticker", "price", "volume", "ts")


@query(
    "str07_two_feeds_candles",
    _INGESTED
    + """select ticker, time_bucket(interval '1 hour', ts) as start_time, cast(min_by(price, seq) as double) as open,
      cast(max_by(price, seq) as double) as close, cast(sum(volume) as double) as volume, count(*) as ticks
    from good group by 1, 2""",
)
def str07_feeds_candles(spark, d):
    job = _two_feeds(spark, d, "str07g")
    return sc.read_merged(spark, job.candle_path).select("ticker", "start_time", "open", "close", "volume", "ticks")


# The second feed is read twice, by two streams: its dead letters are there once for each.
@query(
    "str09_two_feeds_dead",
    _INGESTED + "select seq, reason, case seq % 2 when 0 then 1 else 2 end as streams from parsed where status = 'dead'",
)
def str09_feeds(spark, d):
    dead = spark.read.parquet(_two_feeds(spark, d, "str09f").dead_path)
    return dead.groupBy("seq", "reason").agg(F.count_distinct("stream").cast("int").alias("streams"))


_TOPIC = v.TK + CANDLE_SQL + """select ticker, exchange, "interval", cast(open as double) as open,
  cast(high as double) as high, cast(low as double) as low, cast(close as double) as close,
  cast(volume as double) as volume, start_time, end_time,
  cast(cast(start_time as date) as varchar) as dt from cd"""


@query("str08_consume_write_commit", _TOPIC)
def str08(spark, d):
    from ticklake.sources.candle_topic import encode

    # Run twice over one checkpoint: the second run finds nothing new and writes nothing twice.
    topic = scratch(spark, "str08-topic")
    encode(candles.ohlcv(v.ticks(spark, d), 3600)).select("key", "value").write.parquet(topic)
    path, dead, cp = (scratch(spark, f"str08-{x}") for x in ("out", "dead", "cp"))
    for _ in range(2):
        stream = spark.readStream.schema("key STRING, value STRING").parquet(topic)
        decode_candle_stream(stream, path, dead, cp).awaitTermination()
    return read_candles(spark, path).drop("id", "created_at")


@query("str09_dead_letters", _INGESTED + "select seq, reason from parsed where status = 'dead'")
def str09(spark, d):
    return spark.read.parquet(_ingest(spark, d, "str09").dead_path).select("seq", "reason")


@query("str10_limited_batches", v.TK + "select count(*) as ticks, 4 as batches from tk")
def str10(spark, d):
    # Four files, one per batch: the limit of the source sizes the batches.
    path = scratch(spark, "str10")
    q = sc.write_partials(
        tick_stream(spark, d, "str10-in"), 3600, path, scratch(spark, "str10-cp"), trigger(None)
    )
    q.awaitTermination()
    return sc.read_partials(spark, path).agg(
        F.sum("ticks").alias("ticks"), F.count_distinct("batch_id").cast("int").alias("batches")
    )


@query(
    "str11_running_counts",
    v.TK + "select exchange, ticker, count(*) as n from tk group by 1, 2",
)
def str11(spark, d):
    out = scratch(spark, "str11")

    def latest(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream = counters.running_counts(tick_stream(spark, d, "str11-in"), ["exchange", "ticker"])
    q = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(latest)
        .option("checkpointLocation", scratch(spark, "str11-cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch_id")).scalar()
    return every.where(F.col("batch_id") == last).select("exchange", "ticker", "n")


@query(
    "str12_shards",
    v.TK
    + f"""select ticker, cast(({STABLE_HASH.format('ticker')}) % 4 as integer) as shard, count(*) as n
    from tk group by 1, 2""",
)
def str12(spark, d):
    out = drain(counters.sharded(tick_stream(spark, d, "str12-in"), 4), spark, "str12")
    return out.groupBy("ticker", "shard").agg(F.count("*").alias("n"))


@query(
    "str13_oversized",
    v.MSG + "select seq, case when status = 'dead' then reason else 'oversized' end as reason from parsed",
)
def str13(spark, d):
    # With a limit below every whole message only the short broken ones are judged by content.
    parsed = messages.parse(message_files(spark, d, "str13-in"), "Binance", max_bytes=40)
    return drain(messages.dead_letters(parsed), spark, "str13").select("seq", "reason")

