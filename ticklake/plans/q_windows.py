"""Duplicates, rates, deltas and running counts."""

from pyspark.sql import functions as F

from ticklake.operators import dedup, fifo, metrics, rates
from ticklake.plans import views as v
from ticklake.plans.q_functions import STABLE_HASH
from ticklake.plans.registry import query
from ticklake.session import cut


@query(
    "win01_first_arrival",
    v.FIRST
    + """select trade_id, ticker, exchange, cast(price as double) as price, cast(volume as double) as volume, ts
    from fa""",
)
def win01(spark, d):
    return dedup.first_arrival(v.arrivals(spark, d))


# Half of the ticks carry no trade id: no key may lose its price, and none its volume.
@query(
    "win01_without_trade_ids",
    v.AR
    + """, un as (select *, case when trade_id % 2 = 0 then trade_id end as known from ar),
    fa as (select ticker, exchange, ts, min(known) as trade_id, min_by(price, known) as price,
        count(distinct price) as prices, max(price) as any_price from un group by all)
    select ticker, exchange, ts, trade_id, true as priced,
      case when trade_id is not null then cast(price as double) when prices = 1 then cast(any_price as double) end as price
    from fa""",
)
def win01_without_ids(spark, d):
    a = v.arrivals(spark, d)
    known = a.withColumn("trade_id", F.when(F.col("trade_id") % 2 == 0, F.col("trade_id")))
    out = dedup.first_arrival(known)
    # Where no copy has an id, any copy may stay: its price is compared where all copies agree.
    prices = a.groupBy("ticker", "exchange", "ts").agg(F.count_distinct("price").alias("prices"))
    sure = F.col("trade_id").isNotNull() | (F.col("prices") == 1)
    return out.join(prices, ["ticker", "exchange", "ts"]).select(
        "ticker", "exchange", "ts", "trade_id", (F.col("price").isNotNull() & F.col("volume").isNotNull()).alias("priced"),
        F.when(sure, F.col("price")).alias("price"),
    )


@query(
    "win01_mark_repeats",
    v.AR
    + """select trade_id, trade_id <> min(trade_id) over (partition by ticker, exchange, ts) as repeat from ar""",
)
def win01_marks(spark, d):
    return dedup.mark_repeats(v.arrivals(spark, d)).select("trade_id", "repeat")


# The reference clock counts seconds; the given events are minutes apart, so the same
# operator also runs on an axis of hours.
_RATE = """, ps as (select exchange, cast(floor(epoch(ts) / {unit}) as bigint) as sec, count(*) as n
  from tk group by all)
select exchange, sec, n, cast(sum(n) over w as double) / count(*) over w as rate
from ps window w as (partition by exchange order by sec range between {back} preceding and current row)"""


@query("win02_sliding_rate_60s", v.TK + _RATE.format(unit=1, back=59))
def win02(spark, d):
    return rates.sliding_rate(rates.per_second(v.ticks(spark, d), ["exchange"]), ["exchange"], 60)


@query("win02_sliding_rate_120s", v.TK + _RATE.format(unit=1, back=119))
def win02_wide(spark, d):
    return rates.sliding_rate(rates.per_second(v.ticks(spark, d), ["exchange"]), ["exchange"], 120)


@query("win02_sliding_rate_hours", v.TK + _RATE.format(unit=3600, back=9))
def win02_hours(spark, d):
    hour = F.floor(F.unix_seconds("ts") / 3600).cast("bigint").alias("sec")
    counts = v.ticks(spark, d).groupBy("exchange", hour).agg(F.count("*").alias("n"))
    return rates.sliding_rate(counts, ["exchange"], 10)


@query(
    "win02_sliding_rate_lineitem",
    """with ps as (select l_returnflag as exchange, cast(floor(epoch(l_shipdate) / 86400) as bigint) as sec,
      count(*) as n from lineitem group by all)
    select exchange, sec, n, cast(sum(n) over w as double) / count(*) over w as rate
    from ps window w as (partition by exchange order by sec range between 59 preceding and current row)""",
)
def win02_lineitem(spark, d):
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400).cast("bigint").alias("sec")
    counts = (
        v.table(spark, d, "lineitem")
        .groupBy(F.col("l_returnflag").alias("exchange"), day)
        .agg(F.count("*").alias("n"))
    )
    return rates.sliding_rate(counts, ["exchange"], 60)


@query(
    "win03_counter_deltas",
    v.HEALTH
    + """, ed as (select *, incoming - received as backlog,
        greatest(incoming - received - queued, 0) as dropped from hs),
    pk as (select *, coalesce(max(dropped) over (partition by channel order by ts
        rows between unbounded preceding and 1 preceding), 0) as before,
        coalesce(lag(backlog) over (partition by channel order by ts), 0) as last_backlog from ed)
    select ts, channel, backlog, dropped, nullif(backlog - last_backlog, 0) as backlog_delta,
      case when dropped > before then dropped - before end as dropped_delta from pk""",
)
def win03(spark, d):
    h = metrics.estimated_drops(v.health_samples(spark, d))
    return rates.health_deltas(h, ["channel"]).select(
        "ts", "channel", "backlog", "dropped", "backlog_delta", "dropped_delta"
    )


@query(
    "win03_sample_deltas",
    v.GAUGE
    + """select metric, exchange, ts, cast(value - lag(value) over w as double) as delta,
      cast(epoch_us(ts) - epoch_us(lag(ts) over w) as double) / 1000000 as seconds
    from ga window w as (partition by metric, exchange order by ts)""",
)
def win03_deltas(spark, d):
    return rates.deltas(v.gauges(spark, d), ["metric", "exchange"]).select(
        "metric", "exchange", "ts", "delta", "seconds"
    )


@query(
    "win04_progress_marks",
    v.BATCH
    + """, t as (select *, cast(sum(inserted) over (order by batch_id) as bigint) as total from bl)
    select batch_id, inserted, total from t where total % 200 < inserted""",
)
def win04(spark, d):
    return rates.progress_marks(cut(v.batches(spark, d)), 200).select("batch_id", "inserted", "total")


@query(
    "win04_progress_marks_orders",
    """with t as (select o_orderkey, o_custkey, cast(sum(o_custkey) over (order by o_orderkey) as bigint) as total
      from orders)
    select o_orderkey as batch_id, o_custkey as inserted, total from t where total % 20000 < o_custkey""",
)
def win04_orders(spark, d):
    b = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("inserted")
    )
    return rates.progress_marks(b)


@query(
    "win05_every_nth",
    v.BATCH
    + """, t as (select *, row_number() over (order by batch_id) as rn from bl)
    select batch_id, batch_size from t where rn % 10 = 0""",
)
def win05(spark, d):
    return rates.every_nth(cut(v.batches(spark, d)), 10).select("batch_id", "batch_size")


@query(
    "win06_active_connections",
    v.LOG
    + """select seq, exchange, status, cast(sum(case status when 'Connected' then 1 when 'Disconnected' then -1
      else 0 end) over (partition by exchange order by seq) as bigint) as active from lg""",
)
def win06(spark, d):
    return rates.active_connections(v.status_log(spark, d)).select("seq", "exchange", "status", "active")


@query(
    "win06_unnamed_exchange",
    v.LOG
    + """, un as (select seq, nullif(exchange, 'Kraken') as exchange, status from lg)
    select seq, exchange, status, cast(sum(case status when 'Connected' then 1 when 'Disconnected' then -1
      else 0 end) over (partition by exchange order by seq) as bigint) as active from un""",
)
def win06_unnamed(spark, d):
    log = v.status_log(spark, d).withColumn("exchange", F.nullif("exchange", F.lit("Kraken")))
    return rates.active_connections(log).select("seq", "exchange", "status", "active")


@query(
    "win07_latest_status",
    v.LOG
    + """select n_name as exchange, coalesce(status, 'Disconnected') as status from nation left join (
      select 'NATION_' || (user_id % 20) as exchange, max_by(status, seq) as status
      from lg join events on event_id = seq group by 1) s on s.exchange = n_name""",
)
def win07(spark, d):
    from ticklake.operators.counts import status_of

    place = F.concat(F.lit("NATION_"), (F.col("user_id") % 20).cast("string"))
    log = v.status_log(spark, d).drop("exchange").join(
        v.table(spark, d, "events").select(F.col("event_id").alias("seq"), place.alias("exchange")), "seq"
    )
    return status_of(v.table(spark, d, "nation").select(F.col("n_name").alias("exchange")), log)


# The filter step by step: one recursion step per arrival of a shard, three keys remembered.
FIFO = (
    v.AR.replace("with tk", "with recursive tk")
    + f""", sh as (select *, cast(({STABLE_HASH.format('ticker')}) % 4 as integer) as shard,
        exchange || ticker || ts as key from ar),
    ln as (select *, row_number() over (partition by shard order by trade_id) as rn from sh),
    fi(shard, rn, mem, keep, trade_id) as (
      select distinct shard, cast(0 as bigint), cast([] as varchar[]), false, cast(-1 as bigint) from ln
      union all
      select ln.shard, ln.rn,
        case when list_contains(mem, key) then mem
             else list_append(case when len(mem) >= 3 then mem[2:] else mem end, key) end,
        not list_contains(mem, key), ln.trade_id
      from fi join ln on ln.shard = fi.shard and ln.rn = fi.rn + 1)
    select trade_id, ticker, exchange, ts, sh.shard from fi join sh using (trade_id) where keep"""
)


@query("str06_fifo_batch_by_key", v.FIRST + "select trade_id, ticker, exchange, ts from fa")
def str06_key(spark, d):
    # By whole key: copies of a key meet in one of many shards, whatever its ticker.
    out = fifo.fifo_dedup(v.arrivals(spark, d), size=1 << 20, shards=64, by="key")
    return out.select("trade_id", "ticker", "exchange", "ts")


@query("str06_fifo_batch", FIFO)
def str06_batch(spark, d):
    out = fifo.fifo_dedup(v.arrivals(spark, d), size=3, shards=4, by="ticker")
    return out.select("trade_id", "ticker", "exchange", "ts", "shard")


@query(
    "str06_fifo_large_memory",
    v.FIRST + "select trade_id, ticker, exchange, ts from fa",
)
def str06_large(spark, d):
    # A memory larger than the stream forgets nothing: the first arrivals remain. Shards follow the rows, so that
    # a task remembers no more keys however many there are.
    arrived = v.arrivals(spark, d)
    shards = max(8, -(-arrived.count() // 50_000))
    whole = fifo.fifo_dedup(arrived, size=1 << 40, shards=shards, by="key")
    return whole.select("trade_id", "ticker", "exchange", "ts")
