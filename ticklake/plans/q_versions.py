"""The versioned tick table, partial candles in tiers, and streams with keyed state that can be asked at any time."""

from datetime import datetime

from pyspark.sql import functions as F

from ticklake import versions
from ticklake.operators import dedup, reads, sketches
from ticklake.plans import views as v
from ticklake.plans.q_metrics import _WATCHED, _watched
from ticklake.plans.q_reads import CANDLE_OUT, CANDLE_SQL
from ticklake.plans.q_streaming import _rocksdb, event_stream, split_files, tick_stream
from ticklake.plans.q_windows import _RATE
from ticklake.plans.registry import query
from ticklake.session import scratch
from ticklake.sinks import candle_tiers, versioned
from ticklake.sinks.ticks import to_rows
from ticklake.streaming import alerts, live, postponed

# Several rounds: all first arrivals, a price raised, a flag set, rows deleted, some of them inserted again, a price set.
_EDITED = v.FIRST + """, ed as (
  select trade_id, ticker, exchange, ts, volume,
         case when ticker = 'CLICK' then price + 1 when ticker = 'ERROR' and exchange = 'Kraken' then 7 else price end as price,
         exchange = 'Binance' and ticker <> 'VIEW' as normalized
  from fa where not (ticker = 'SIGNUP' and trade_id % 3 = 0))"""
_EDITED_OUT = """select trade_id, ticker, exchange, ts, cast(price as double) as price, cast(volume as double) as volume,
  normalized from ed"""


def _edited(spark, d, label, fold=False):
    path = scratch(spark, label)
    arrived = v.arrivals(spark, d)
    first = dedup.first_arrival(arrived)
    versioned.insert_new(spark, arrived, path)
    versioned.update_rows(spark, path, first.where("ticker = 'CLICK'").withColumn("price", F.col("price") + 1), ["price"])
    versioned.mark_normalized(spark, path, first.where("exchange = 'Binance'"))
    if fold:
        versioned.fold(spark, path)
    versioned.delete_rows(spark, path, first.where("ticker = 'VIEW' or (ticker = 'SIGNUP' and trade_id % 3 = 0)"))
    versioned.insert_new(spark, arrived.where("ticker = 'VIEW'"), path)
    seven = F.lit(7).cast("decimal(18,8)")
    versioned.update_rows(spark, path, first.where("ticker = 'ERROR' and exchange = 'Kraken'").withColumn("price", seven), ["price"])
    if fold:
        versioned.fold(spark, path)
        versions.vacuum(spark, path, keep=1)
    return path


def _columns(df):
    return df.select("trade_id", "ticker", "exchange", "ts", "price", "volume", "normalized")


@query("snk13_merge_on_read", _EDITED + _EDITED_OUT)
def snk13_merged(spark, d):
    return _columns(versioned.read(spark, _edited(spark, d, "snk13-m")))


@query("snk13_folded_edits", _EDITED + _EDITED_OUT)
def snk13_folded(spark, d):
    return _columns(versioned.read(spark, _edited(spark, d, "snk13-f", fold=True)))


@query("flt06_after_edits", _EDITED + _EDITED_OUT + " where not normalized order by ts, trade_id limit 1000")
def flt06_edits(spark, d):
    return _columns(reads.unnormalized(versioned.read(spark, _edited(spark, d, "flt06-e")), 1000))


# A reader that was pinned before the edits sees the first version still.
@query("snk13_pinned_reader", v.FIRST + "select trade_id, cast(price as double) as price, false as normalized from fa")
def snk13_pinned(spark, d):
    path = _edited(spark, d, "snk13-p")
    return versioned.read(spark, path, versions.at(spark, path, 1)).select("trade_id", "price", "normalized")


# While the writer of the even ticks waits to commit, that of the odd ones is done: its rows stay.
@query(
    "snk01_two_writers",
    v.AR
    + """, wr as (select *, case when trade_id % 2 = 1 then 0 else 1 end as late from ar)
    select ticker, exchange, ts, min(trade_id + late * 1000000000000) % 1000000000000 as trade_id,
      cast(min_by(price, trade_id + late * 1000000000000) as double) as price from wr group by 1, 2, 3""",
)
def snk01_two(spark, d):
    path, arrived, ran = scratch(spark, "snk01-two"), v.arrivals(spark, d), []

    def other():
        if not ran:
            ran.append(versioned.insert_new(spark, arrived.where("trade_id % 2 = 1"), path))

    versioned.insert_new(spark, arrived.where("trade_id % 2 = 0"), path, between=other)
    return versioned.read(spark, path).select("ticker", "exchange", "ts", "trade_id", "price")


@query("str03_tiered_candles", v.TK + CANDLE_SQL + CANDLE_OUT)
def str03_tiers(spark, d):
    # Eight batches, merged two by two; the batches after the first few reach days that were merged before.
    shuffled = v.table(spark, d, "events").withColumn("_o", F.pmod(F.xxhash64("event_id"), F.lit(1 << 20)))
    src, path = split_files(spark, shuffled, "str03t-in", "_o", 8), scratch(spark, "str03t")
    events = spark.readStream.schema(shuffled.schema).option("maxFilesPerTrigger", 1).parquet(src)
    candle_tiers.write_stream(v.tick_columns(events), 3600, path, scratch(spark, "str03t-cp"), fan=2).awaitTermination()
    return candle_tiers.read(spark, path)


@query("str10_postponed_batches", v.TK + "select count(*) as ticks, 3 as commits from tk")
def str10_postponed(spark, d):
    # Eight small batches become three commits: at the third, the sixth, and the flush.
    src, path = split_files(spark, v.ticks(spark, d), "str10p-in", "trade_id", 8), scratch(spark, "str10p")
    ticks = v.ticks(spark, d)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(src)
    least = int(ticks.count() * 0.31)
    postponed.write_stream(stream, path, scratch(spark, "str10p-cp"), rows=least, seconds=1e9).awaitTermination()
    postponed.flush(spark, path)
    commits = len({e.commit for e in versions.latest(spark, path).of(versions.ROWS)})
    return versioned.read(spark, path).agg(F.count("*").alias("ticks")).withColumn("commits", F.lit(commits))


def updates(stream, spark, label):
    """Run a stream that updates its rows to its end and return all it wrote."""
    out = scratch(spark, label)

    def sink(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")

    with _rocksdb(spark):
        q = stream.writeStream.outputMode("update").foreachBatch(sink)
        q.option("checkpointLocation", scratch(spark, label + "-cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


@query("win02_stream_rate_60s", v.TK + _RATE.format(unit=1, back=59))
def win02_stream(spark, d):
    out = updates(live.sliding_rates(tick_stream(spark, d, "win02s-in"), ["exchange"], 60), spark, "win02s")
    return live.latest(out, ["exchange", "sec"])


@query("met03_stream_alerts", _WATCHED + "select * from fi")
def met03_stream(spark, d):
    watched = _watched(spark, d)
    src = split_files(spark, watched, "met03s-in", "ts")
    samples = spark.readStream.schema(watched.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = updates(alerts.alerts(samples, ["exchange"], window_s=21600), spark, "met03s")
    return out.where("event = 'sample'").drop("event")


# Every fiftieth signup resets the counter of its exchange.
_RESETS = v.TK + """, rs as (
    select distinct exchange, epoch_ms(date_trunc('milliseconds', ts)) as since from tk where ticker = 'SIGNUP' and trade_id % 50 = 0),
  ep as (select tk.exchange, max(since) as since, trade_id from tk left join rs
    on rs.exchange = tk.exchange and rs.since <= epoch_ms(date_trunc('milliseconds', tk.ts)) group by tk.exchange, trade_id)
  select exchange, since, count(*) as n from ep group by 1, 2"""


@query("str11_counts_with_resets", _RESETS)
def str11_resets(spark, d):
    ticks = v.tick_columns(event_stream(spark, d, "str11r-in"))
    events = live.with_resets(ticks, ticks.where("ticker = 'SIGNUP' and trade_id % 50 = 0"), ["exchange"])
    out = updates(live.resettable_counts(events, ["exchange"]), spark, "str11r")
    return live.latest(out, ["exchange", "since"]).where("n > 0")


def _folded(spark, d, label):
    path = scratch(spark, label)
    ticks = v.ticks(spark, d)
    versioned.insert_new(spark, ticks.where("exchange = 'Binance'"), path)
    versioned.insert_new(spark, ticks, path)
    versioned.fold(spark, path, most_files=1)
    return path


# The key of a tick is unique but for ticks of one instant, of which the first stays.
_FOUND = v.TK + """, ft as (select ticker, exchange, ts, min(trade_id) as trade_id, min_by(price, trade_id) as price
  from tk group by all) select ticker, exchange, ts, trade_id, cast(price as double) as price from ft"""


@query("flt05_by_id_folded", _FOUND + " where trade_id = 77")
def flt05_folded(spark, d):
    table = versioned.read(spark, _folded(spark, d, "flt05-f"))
    (row_id,) = table.where("trade_id = 77").select("id").first()
    found = reads.by_id(table, row_id)
    return found.select("ticker", "exchange", "ts", "trade_id", "price")


@query("join02_find_keys", _FOUND + " where trade_id % 7 = 0")
def join02_find(spark, d):
    path = _folded(spark, d, "join02-f")
    keys = versioned.read(spark, path).where("trade_id % 7 = 0").select("ticker", "exchange", "ts")
    return versioned.find(spark, path, keys).select("ticker", "exchange", "ts", "trade_id", "price")


# Quantiles of two days out of stored sketches. Their values may differ from the exact ones by a part of the ranks,
# so what is compared is the number of samples, which is exact, and that each rank is within twice the stated bound.
@query(
    "met10_sketched_quantiles",
    v.GAUGE
    + """, q as (select unnest([0.5, 0.95, 0.99])::double as q)
    select metric, exchange, q, count(*) as n, true as within from ga, q
    where ts >= timestamp '2024-01-09' and ts < timestamp '2024-01-11' group by all""",
)
def met10_sketched(spark, d):
    path, keys = scratch(spark, "met10s"), ["metric", "exchange"]
    gauges = v.gauges(spark, d)
    sketches.write(sketches.sketched(gauges, keys), path)
    start, end = datetime(2024, 1, 9), datetime(2024, 1, 11)
    whole = sketches.merged(sketches.read(spark, path, gauges.select(*keys).schema, start, end), keys)
    levels = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), sketches.quantile(F.col("sketch"), q).alias("x")) for q in (0.5, 0.95, 0.99)]))
    asked = whole.select(*keys, "n", levels.alias("l")).select(*keys, "n", "l.q", "l.x")
    raw = gauges.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    ranks = raw.join(asked, keys).groupBy(*keys, "q", "n").agg(
        F.count_if(F.col("value").cast("double") < F.col("x")).alias("below"),
        F.count_if(F.col("value").cast("double") <= F.col("x")).alias("upto"),
    )
    most = 2 * sketches.rank_error()
    fits = (F.col("below") / F.col("n") - F.col("q") <= most) & (F.col("q") - F.col("upto") / F.col("n") <= most)
    return ranks.select(*keys, "q", "n", fits.alias("within"))


@query(
    "mnt04_adopted_table",
    v.TK + "select cast(cast(ts as date) as varchar) as dt, ticker, count(*) as rows from tk group by 1, 2",
)
def mnt04_adopted(spark, d):
    flat, path = scratch(spark, "mnt04-flat"), scratch(spark, "mnt04-v")
    to_rows(v.ticks(spark, d)).drop("dt").write.parquet(flat)
    versioned.adopt(spark, spark.read.parquet(flat), path)
    return versioned.read(spark, path).groupBy("dt", "ticker").agg(F.count("*").alias("rows"))
