"""Candles, counts and run reports."""

from pyspark.sql import functions as F

from ticklake.operators import candles, counts, metrics, ordered, runs
from ticklake.plans import views as v
from ticklake.plans.q_reads import CANDLE_OUT, CANDLE_SQL
from ticklake.plans.registry import query


def _candle_sql(bucket: str, label: str, source: str = "tk", first="trade_id", last="trade_id") -> str:
    return f"""
    select ticker, exchange, '{label}' as "interval", cast(min_by(price, {first}) as double) as open,
      cast(max(price) as double) as high, cast(min(price) as double) as low,
      cast(max_by(price, {last}) as double) as close, cast(sum(volume) as double) as volume,
      {bucket} as start_time, {bucket} + interval {{step}} as end_time, count(*) as ticks,
      min(trade_id) as first_seq, max(trade_id) as last_seq
    from {source} group by ticker, exchange, {bucket}"""


_H, _D, _M = (f"time_bucket(interval '1 {u}', ts)" for u in ("hour", "day", "minute"))


@query("agg01_ohlcv_1h", v.TK + CANDLE_SQL + CANDLE_OUT)
def agg01(spark, d):
    return candles.ohlcv(v.ticks(spark, d), 3600)


@query("agg01_ohlcv_1m", v.TK + _candle_sql(_M, "1m").format(step="1 minute"))
def agg01_minute(spark, d):
    return candles.ohlcv(v.ticks(spark, d), 60)


@query("agg01_ohlcv_1d_event_time", v.TK + _candle_sql(_D, "1440m", first="ts", last="ts").format(step="1 day"))
def agg01_event_time(spark, d):
    return candles.ohlcv(v.ticks(spark, d), 86400, order="event_time")


@query(
    "agg01_ohlcv_raw_and_deduped",
    v.FIRST
    + """, r as (select ticker, exchange, sum(volume) as raw_volume, count(*) as raw_ticks from ar group by all),
    f as (select ticker, exchange, sum(volume) as volume, count(*) as ticks from fa group by all)
    select ticker, exchange, cast(raw_volume as double) as raw_volume, raw_ticks,
      cast(volume as double) as volume, ticks from r join f using (ticker, exchange)""",
)
def agg01_raw(spark, d):
    from ticklake.operators.dedup import first_arrival

    ar = v.arrivals(spark, d)
    raw = candles.ohlcv(ar, 86400).groupBy("ticker", "exchange").agg(
        F.sum("volume").alias("raw_volume"), F.sum("ticks").alias("raw_ticks")
    )
    clean = candles.ohlcv(first_arrival(ar), 86400).groupBy("ticker", "exchange").agg(
        F.sum("volume").alias("volume"), F.sum("ticks").alias("ticks")
    )
    return raw.join(clean, ["ticker", "exchange"])


# Ticks without any trade id: open and close follow the clock, and none is lost.
@query(
    "agg01_without_trade_ids",
    v.TK
    + """, cd as (select ticker, exchange, time_bucket(interval '1 hour', ts) as start_time, count(*) as ticks,
        min_by(price, ts) as open, max_by(price, ts) as close, min(ts) as lo, max(ts) as hi from tk group by all)
    select cd.ticker, cd.exchange, start_time, ticks, cast(open as double) as open, cast(close as double) as close
    from cd""",
)
def agg01_without_ids(spark, d):
    bare = v.ticks(spark, d).withColumn("trade_id", F.lit(None).cast("bigint"))
    return candles.ohlcv(bare, 3600).select("ticker", "exchange", "start_time", "ticks", "open", "close")


# Line items carry no unique number: they arrive by ship date, order and line, then price, quantity and part.
_ARRIVAL = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey"]


@query(
    "agg01_ohlcv_lineitem",
    f"""with li as (select *, row_number() over (order by {", ".join(_ARRIVAL)}) as arrival from lineitem)
    select 'P' || l_partkey as ticker, l_returnflag as exchange, cast(min_by(l_extendedprice, arrival) as double) as open,
      cast(max(l_extendedprice) as double) as high, cast(min(l_extendedprice) as double) as low,
      cast(max_by(l_extendedprice, arrival) as double) as close, cast(sum(l_quantity) as double) as volume,
      time_bucket(interval '1 day', l_shipdate) as start_time, count(*) as ticks
    from li group by all""",
)
def agg01_lineitem(spark, d):
    day = ordered.time_chunk("_at", 86400)
    lines = v.table(spark, d, "lineitem").withColumn("_at", F.col("l_shipdate").cast("timestamp"))
    placed = ordered.row_numbers(lines, [], _ARRIVAL, "arrival", day)
    ticks = line_columns(placed).withColumn("trade_id", F.col("arrival").cast("bigint")).drop("arrival")
    return candles.ohlcv(ticks, 86400).select(
        "ticker", "exchange", "open", "high", "low", "close", "volume", "start_time", "ticks"
    )


def line_ticks(spark, d):
    return line_columns(v.table(spark, d, "lineitem"))


def line_columns(lines):
    return lines.select(
        *[c for c in lines.columns if c == "arrival"],
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trade_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"),
        F.col("l_returnflag").alias("exchange"),
        F.col("l_extendedprice").cast("decimal(18,8)").alias("price"),
        F.col("l_quantity").cast("decimal(18,8)").alias("volume"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


@query("agg02_merge_partials", v.TK + CANDLE_SQL + CANDLE_OUT)
def agg02(spark, d):
    # Two sets of partial candles (by price) merged must equal the candles of the whole.
    t = v.ticks(spark, d)
    low = candles.ohlcv(t.where(F.col("price") <= 50), 3600)
    high = candles.ohlcv(t.where(F.col("price") > 50), 3600)
    return candles.merge_partials(low.unionByName(high))


@query("agg02_coarsen", v.TK + _candle_sql(_D, "1440m").format(step="1 day"))
def agg02_coarsen(spark, d):
    return candles.coarsen(candles.ohlcv(v.ticks(spark, d), 60), 86400)


@query(
    "agg03_count_range",
    v.TK + "select count(*) as n from tk where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20 12:00:00'",
)
def agg03(spark, d):
    from ticklake.operators.reads import time_range
    from ticklake.plans.q_reads import FROM, TO

    return time_range(v.ticks(spark, d), FROM, TO).agg(F.count("*").alias("n"))


@query("agg05_per_exchange", v.TK + "select exchange, count(*) as n from tk group by rollup(exchange)")
def agg05(spark, d):
    return counts.per_exchange(v.ticks(spark, d))


@query(
    "agg05_listed_exchanges",
    """select n_name as exchange, count(event_id) as n from nation
    left join events on n_name = 'NATION_' || (user_id % 10) group by 1""",
)
def agg05_listed(spark, d):
    t = v.table(spark, d, "events").select(
        F.concat(F.lit("NATION_"), (F.col("user_id") % 10).cast("string")).alias("exchange")
    )
    return counts.per_exchange_of(v.table(spark, d, "nation").select(F.col("n_name").alias("exchange")), t)


@query("agg06_per_symbol", v.TK + "select exchange, ticker as symbol, count(*) as n from tk group by all")
def agg06(spark, d):
    return counts.per_symbol(v.ticks(spark, d))


@query(
    "agg07_per_tag",
    """select case user_id % 3 when 0 then 'binance' when 1 then 'kraken' else 'unknown' end as tag, count(*) as n
    from events group by 1""",
)
def agg07(spark, d):
    kind = F.col("user_id") % 3
    name = F.when(kind == 0, "Binance").when(kind == 1, "Kraken").otherwise("binance")
    return counts.per_tag(v.table(spark, d, "events").select(name.alias("exchange")))


@query(
    "agg08_timings",
    v.RUNS
    + """select test_name, count(*) as iterations, cast(sum(elapsed_ms) as double) / count(*) as avg_ms,
      cast(min(elapsed_ms) as double) as min_ms, cast(max(elapsed_ms) as double) as max_ms,
      max_by(rows, iteration) as rows from rn group by 1""",
)
def agg08(spark, d):
    return runs.timings(v.runs(spark, d))


@query(
    "agg09_best_per_mode",
    v.RUNS
    + """select mode, method, chunk_size, ticks_per_sec, run_id from rn
    qualify row_number() over (partition by mode order by ticks_per_sec desc, run_id) = 1""",
)
def agg09(spark, d):
    return runs.best_per_mode(v.runs(spark, d))


@query(
    "agg11_errors_by_type",
    """select event_type as exception_type,
      coalesce(case when k >= 50 then k::varchar end, 'none') as sql_state, count(*) as n
    from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events) group by 1, 2""",
)
def agg11(spark, d):
    k = F.get_json_object("props", "$.k")
    e = v.table(spark, d, "events").select(
        F.col("event_type").alias("exception_type"), F.when(k.cast("int") >= 50, k).alias("sql_state")
    )
    return counts.errors_by_type(e)


BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0]
_HISTOGRAM = (
    """, le as (select unnest([5, 10, 25, 50, 75, 100, 250]::double[] || ['infinity'::double]) as le),
  hg as (select ticker, le, count_if(cast(price as double) <= le) as cumulative, count(*) as count,
         cast(sum(price) as double) as sum from tk cross join le group by all)"""
)
_FINITE = "case when le < 1e300 then le else -1 end as le"


def _histogram(spark, d):
    t = v.ticks(spark, d)
    return metrics.observe(t.withColumn("x", F.col("price").cast("double")), ["ticker"], "x", BOUNDS, total="price")


@query("agg12_histogram", v.TK + _HISTOGRAM + f'select ticker, {_FINITE}, cumulative, "count", "sum" from hg')
def agg12(spark, d):
    h = _histogram(spark, d)
    open_end = F.col("le") == F.lit(float("inf"))
    return h.withColumn("le", F.when(open_end, -1.0).otherwise(F.col("le")))


@query(
    "met10_histogram_mean",
    v.TK + 'select ticker, count(*) as "count", cast(sum(price) as double) as "sum", '
    "cast(sum(price) as double) / count(*) as mean from tk group by 1",
)
def met10_mean(spark, d):
    return metrics.histogram_means(_histogram(spark, d), ["ticker"])


@query(
    "met10_histogram_quantile",
    v.TK
    + _HISTOGRAM
    + """, st as (select ticker, le, cumulative, 0.95 * "count" as rank,
        coalesce(lag(le) over w, 0) as lo, coalesce(lag(cumulative) over w, 0) as below
      from hg window w as (partition by ticker order by le))
    select ticker, round(case when le > 1e300 then lo
        else lo + (le - lo) * (cast(rank as double) - below) / (cumulative - below) end, 6) as quantile
    from st where cumulative >= rank and below < rank""",
)
def met10_quantile(spark, d):
    q = metrics.histogram_quantile(_histogram(spark, d), ["ticker"], 0.95)
    return q.withColumn("quantile", F.round("quantile", 6))


@query(
    "met10_raw_quantiles",
    """select l_returnflag, quantile_disc(cast(l_quantity as integer), 0.5) as median,
      quantile_disc(cast(l_quantity as integer), 0.95) as p95 from lineitem group by 1""",
)
def met10_raw(spark, d):
    rows = v.table(spark, d, "lineitem").withColumn("x", F.col("l_quantity").cast("int"))
    return metrics.exact_quantiles(rows, ["l_returnflag"], "x", {"median": 0.5, "p95": 0.95})


@query(
    "met10_insert_efficiency",
    v.BATCH
    + """select channel, count(*) as batches, cast(sum(batch_size) as bigint) as received,
      cast(sum(inserted) as bigint) as inserted,
      cast(sum(inserted) as double) / cast(sum(batch_size) as double) as efficiency,
      cast(max(duration_ms) as double) as max_ms from bl group by 1""",
)
def met10_efficiency(spark, d):
    return metrics.insert_efficiency(v.batches(spark, d), ["channel"])


@query(
    "agg13_metric_catalog",
    v.GAUGE
    + "select metric, count(*) as rows, min(ts) as first_sample, max(ts) as last_sample from ga group by 1",
)
def agg13(spark, d):
    return metrics.catalog(v.gauges(spark, d))


@query(
    "agg13_sample_times",
    v.GAUGE
    + """select count(distinct ts) as samples, min(ts) as first_sample, max(ts) as last_sample from ga""",
)
def agg13_times(spark, d):
    return metrics.sample_times(v.gauges(spark, d))


@query(
    "agg14_gauge_total",
    v.BATCH
    + """select ts, cast(sum(cached) as bigint) as total, count(cached) as samples,
      case when count(cached) > 0 then sum(cached) <= 0 end as drained from bl group by ts""",
)
def agg14(spark, d):
    return metrics.gauge_totals(v.batches(spark, d), value="cached")


@query(
    "agg15_throughput",
    v.RUNS
    + """select method, mode, chunk_size, cast(sum(total_ticks) as bigint) as total_ticks,
      cast(sum(elapsed_ms) as double) as elapsed_ms,
      cast(sum(total_ticks) as double) * 1000 / cast(sum(elapsed_ms) as double) as ticks_per_sec
    from rn group by all""",
)
def agg15(spark, d):
    return runs.throughput(v.runs(spark, d))
