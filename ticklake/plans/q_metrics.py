"""Metric analytics, alerts and health."""

from pyspark.sql import functions as F

from ticklake.operators import candles, counts, dedup, metrics, rates
from ticklake.plans import views as v
from ticklake.plans.q_reads import CANDLE_SQL
from ticklake.plans.registry import query


@query(
    "met01_interval_throughput",
    v.HEALTH
    + """, x as (select channel, ts, incoming, incoming - lag(incoming) over w as delta,
        cast(epoch_us(ts) - epoch_us(lag(ts) over w) as double) / 1000000 as seconds
      from hs window w as (partition by channel order by ts))
    select channel, ts, delta, seconds, cast(delta as double) / seconds as per_second from x where delta is not null""",
)
def met01(spark, d):
    h = v.health_samples(spark, d).select("channel", "ts", F.col("incoming").alias("value"))
    return rates.interval_throughput(h, ["channel"]).drop("value")


_RATE = """, st as (select *, lag(value) over (partition by metric, exchange order by ts) as prev from {src}),
    gr as (select *, case when prev is null then 0 when value < prev then value else value - prev end as grow from st),
    rt as (select *, case when count(*) over w > 1
          then cast(sum(grow) over w - first_value(grow) over w as double) / 21600.0 end as rate
        from gr window w as (partition by metric, exchange order by ts
          range between interval 21599.999 seconds preceding and current row))"""


@query(
    "met02_counter_rate",
    v.GAUGE + _RATE.format(src="ga") + "select metric, exchange, ts, cast(value as double) as value, rate from rt",
)
def met02(spark, d):
    # Raw gauge values fall all the time, so every fall is a counter reset.
    return metrics.counter_rate(v.gauges(spark, d), ["metric", "exchange"], 21600).select(
        "metric", "exchange", "ts", "value", "rate"
    )


@query(
    "met03_threshold",
    v.GAUGE + "select metric, exchange, ts, cast(value as double) as value from ga where value > 75",
)
def met03(spark, d):
    g = v.gauges(spark, d)
    return g.where(metrics.breaches(F.col("value"), ">", 75)).select("metric", "exchange", "ts", "value")


_HELD = """, ac as (select *, {cond} as active from {src}),
    isl as (select *, sum(case when active then 0 else 1 end) over (partition by {keys} order by ts) as g from ac),
    sn as (select *, case when active then min(case when active then ts end)
        over (partition by {keys}, g) end as since from isl)"""


@query(
    "met04_for_duration",
    v.GAUGE
    + _HELD.format(cond="value > 20", src="ga", keys="metric, exchange")
    + """select metric, exchange, ts, active, since, active and ts - since >= interval 2 hour as firing from sn""",
)
def met04(spark, d):
    held = metrics.held_for(v.gauges(spark, d), ["metric", "exchange"], F.col("value") > 20, 7200)
    return held.select("metric", "exchange", "ts", "active", "since", F.coalesce("firing", F.lit(False)).alias("firing"))


# The second exchange's name is missing: its series must not vanish.
_UNNAMED = v.GAUGE + """, un as (select metric, nullif(exchange, 'Kraken') as exchange, ts, value from ga)"""


def _unnamed(spark, d):
    return v.gauges(spark, d).withColumn("exchange", F.nullif("exchange", F.lit("Kraken")))


@query(
    "met02_unnamed_series",
    _UNNAMED + _RATE.format(src="un") + "select metric, exchange, ts, cast(value as double) as value, rate from rt",
)
def met02_unnamed(spark, d):
    return metrics.counter_rate(_unnamed(spark, d), ["metric", "exchange"], 21600).select(
        "metric", "exchange", "ts", "value", "rate"
    )


@query(
    "met04_gaps_and_unnamed",
    _UNNAMED
    + """, ac as (select *, value > 20 as active, lag(ts) over w as before, lag(value > 20) over w as was from un
        window w as (partition by metric, exchange order by ts)),
    isl as (select *, sum(case when active and was and ts - before <= interval 3 hour then 0 else 1 end)
        over (partition by metric, exchange order by ts) as g from ac),
    sn as (select *, case when active then min(ts) over (partition by metric, exchange, g) end as since from isl)
    select metric, exchange, ts, active, since, coalesce(active and ts - since >= interval 2 hour, false) as firing
    from sn""",
)
def met04_gaps(spark, d):
    held = metrics.held_for(_unnamed(spark, d), ["metric", "exchange"], F.col("value") > 20, 7200, max_gap_s=10800)
    return held.select("metric", "exchange", "ts", "active", "since", "firing")


@query(
    "met03_threshold_nan",
    v.GAUGE + "select metric, exchange, ts from ga where value > 75 and exchange = 'Binance'",
)
def met03_nan(spark, d):
    # NaN is above every number in Spark's order; it must not break a limit.
    value = F.when(F.col("exchange") == "Binance", F.col("value").cast("double")).otherwise(F.lit(float("nan")))
    return v.gauges(spark, d).where(metrics.breaches(value, ">", 75)).select("metric", "exchange", "ts")


# Samples under the names the alert rules watch; values scaled so that rules fire.
_NAMES = {
    "click": ("processor_channel_backlog", 2000),
    "view": ("ws_active_connections", None),
    "signup": ("probe_success", None),
    "purchase": ("ticks_dropped_silently_total", 10_000_000),
    "error": ("exceptions_total", 100_000),
}


def _watched(spark, d):
    g = v.gauges(spark, d)
    name, value = F.lit(None), F.lit(None)
    for metric, (target, scale) in _NAMES.items():
        here = F.col("metric") == metric
        number = F.col("value") * scale if scale else F.floor(F.col("value") / 25)
        name = F.when(here, target).otherwise(name)
        value = F.when(here, number.cast("decimal(30,2)")).otherwise(value)
    job = F.concat(F.lit('job="'), F.when(F.col("exchange") == "Binance", "blackbox-health").otherwise("node"), F.lit('"'))
    return g.select(name.alias("metric"), "exchange", "ts", value.alias("value"), job.alias("labels"))


_WATCHED = (
    v.GAUGE
    + """, wa as (select case metric when 'click' then 'processor_channel_backlog'
      when 'view' then 'ws_active_connections' when 'signup' then 'probe_success'
      when 'purchase' then 'ticks_dropped_silently_total' else 'exceptions_total' end as metric, exchange, ts,
    cast(case metric when 'click' then value * 2000 when 'purchase' then value * 10000000
      when 'error' then value * 100000 else floor(value / 25) end as decimal(30,2)) as value from ga)"""
    + _RATE.format(src="wa")
    + """, rules(alertname, severity, metric, op, lim, hold) as (values
      ('MarketDataChannelBacklogHigh', 'warning', 'processor_channel_backlog', '>', 50000, 2),
      ('MarketDataChannelBacklogCritical', 'critical', 'processor_channel_backlog', '>', 100000, 2),
      ('MarketDataTicksDropped', 'warning', 'ticks_dropped_silently_total', '>', 1000, 2),
      ('MarketDataAllWebSocketsDown', 'critical', 'ws_active_connections', '==', 0, 3),
      ('MarketDataWebSocketsDegraded', 'warning', 'ws_active_connections', '<', 3, 5),
      ('MarketDataExceptionsSpike', 'warning', 'exceptions_total', '>', 10, 5),
      ('MarketDataWorkerUnhealthy', 'critical', 'probe_success', '==', 0, 2)),
    rd as (select metric, exchange, ts, case when metric in ('ticks_dropped_silently_total', 'exceptions_total')
        then rate else cast(value as double) end as value from rt),
    al as (select alertname, severity, hold, exchange, ts, value, coalesce(case op when '>' then value > lim
        when '<' then value < lim else value = lim end, false) as active from rd join rules using (metric)
      where alertname <> 'MarketDataWorkerUnhealthy' or exchange = 'Binance'),
    isl as (select *, sum(case when active then 0 else 1 end) over (partition by alertname, exchange order by ts) as g
      from al),
    sn as (select *, min(case when active then ts end) over (partition by alertname, exchange, g) as since from isl),
    fi as (select alertname, severity, exchange, ts, value, since from sn
      where active and ts - since >= hold * interval 1 minute)"""
)


@query("met03_alert_rules", _WATCHED + "select * from fi")
def met03_rules(spark, d):
    return metrics.evaluate_rules(_watched(spark, d), ["exchange"], window_s=21600)


@query(
    "met05_alert_groups",
    _WATCHED
    + "select alertname, severity, count(*) as n, min(ts) as first_at, max(ts) as last_at from fi group by 1, 2",
)
def met05(spark, d):
    return metrics.alert_groups(metrics.evaluate_rules(_watched(spark, d), ["exchange"], window_s=21600))


@query(
    "met06_fill_levels",
    v.BATCH
    + """, la as (select channel, max_by(cached, ts) as cnt, max_by(batch_size, ts) as capacity from bl group by 1)
    select channel, cast(sum(cnt) as bigint) as "count", cast(sum(capacity) as bigint) as capacity,
      round(case when sum(capacity) > 0 then cast(sum(cnt) as double) / cast(sum(capacity) as double) * 100
        else 0 end, 1) as fill_pct
    from la group by rollup(channel)""",
)
def met06(spark, d):
    b = v.batches(spark, d).select(
        "ts", "channel", F.col("cached").alias("count"), F.col("batch_size").alias("capacity")
    )
    return metrics.fill_levels(b)


@query(
    "met07_estimated_drops",
    v.HEALTH
    + """select ts, channel, incoming, received, queued, incoming - received as backlog,
      greatest(incoming - received - queued, 0) as dropped from hs""",
)
def met07(spark, d):
    return metrics.estimated_drops(v.health_samples(spark, d))


_BALANCE = v.BATCH + """, bal as (
  select cast(sum(batch_size) as bigint) as received, cast(sum(inserted) as bigint) as processed,
         cast(sum(cached) as bigint) as dedup_cache,
         cast(sum(batch_size - cached - inserted) as bigint) as dedup_db from bl)"""


@query(
    "met08_balance",
    _BALANCE + "select *, received - processed = dedup_cache + dedup_db as balanced from bal",
)
def met08(spark, d):
    return dedup.balance(v.batches(spark, d))


@query(
    "met09_dedup_shares",
    _BALANCE
    + """, lv as (select 'cache' as level, dedup_cache as removed, * from bal union all
      select 'db', dedup_db, * from bal union all select 'total', dedup_cache + dedup_db, * from bal)
    select level, removed, removed * 100.0::double / received as pct_of_received,
      removed * 100.0::double / (dedup_cache + dedup_db) as pct_of_removed from lv""",
)
def met09(spark, d):
    return dedup.shares(dedup.balance(v.batches(spark, d)))


@query(
    "met11_symbol_shares",
    v.TK + "select ticker, count(*) as n, count(*) * 100.0::double / sum(count(*)) over () as pct from tk group by 1",
)
def met11(spark, d):
    return counts.symbol_shares(v.ticks(spark, d))


@query(
    "met12_run_deltas",
    v.GAUGE
    + """select metric, exchange, cast(min_by(value, ts) as double) as first_value,
      cast(max_by(value, ts) as double) as last_value,
      cast(epoch_us(max(ts)) - epoch_us(min(ts)) as double) / 1000000 as seconds,
      cast(max_by(value, ts) - min_by(value, ts) as double) as delta,
      cast(max_by(value, ts) - min_by(value, ts) as double)
        / (cast(epoch_us(max(ts)) - epoch_us(min(ts)) as double) / 1000000) as per_second
    from ga group by 1, 2""",
)
def met12(spark, d):
    return metrics.run_deltas(v.gauges(spark, d), ["metric", "exchange"])


_NAMED = v.TK + """, s as (select case when ticker = 'ERROR' then 'process_runtime_errors'
      when ticker = 'VIEW' then 'target_info' else lower(ticker) end as metric, exchange as labels,
      date_trunc('day', ts) as ts, cast(sum(price) as double) as value from tk group by all)"""


def _daily(spark, d):
    name = (
        F.when(F.col("ticker") == "ERROR", "process_runtime_errors")
        .when(F.col("ticker") == "VIEW", "target_info")
        .otherwise(F.lower("ticker"))
    )
    return v.ticks(spark, d).groupBy(
        name.alias("metric"), F.col("exchange").alias("labels"), F.date_trunc("day", "ts").alias("ts")
    ).agg(F.sum("price").alias("value"))


@query(
    "met13_last_sample",
    _NAMED
    + """select metric, labels, ts, value from s where ts = (select max(ts) from s)
    and not regexp_matches(metric, '^process_runtime|^target_info')""",
)
def met13(spark, d):
    return metrics.last_sample_listing(_daily(spark, d))


@query(
    "met14_drain_time",
    v.BATCH
    + """, tt as (select ts, cast(sum(cached) as bigint) as total from bl group by 1),
    pk as (select max(total) as peak from tt),
    pt as (select min(ts) as top from tt, pk where total = peak)
    select min(case when ts >= top and total <= 0 then ts end) as drained_at, max(total) as peak from tt, pt""",
)
def met14(spark, d):
    return metrics.drain_time(metrics.gauge_totals(v.batches(spark, d), value="cached"))


@query(
    "met15_channel_shares",
    v.BATCH
    + """, p as (select channel, cast(sum(batch_size) as bigint) as total from bl group by 1)
    select channel, total, total * 100.0::double / (select sum(total) from p) as pct,
      total * 1.0::double * (select count(*) from p) / (select sum(total) from p) as imbalance from p""",
)
def met15(spark, d):
    return metrics.channel_shares(v.batches(spark, d))



@query(
    "met17_health",
    v.LOG
    + """, comp as (select event_type as name, case when event_type = 'error' then 'unhealthy'
        when event_type = 'view' then 'disabled' else 'healthy' end as status from events),
    cl as (select exchange, max_by(status, seq) = 'Connected' as connected from lg group by 1),
    ws as (select count(*) as total, count_if(connected) as connected from cl)
    select s.scenario, case when (s.scenario = 'all' and (select count(*) from comp where status = 'unhealthy') > 0)
        or (total > 0 and connected = 0) then 'degraded' else 'healthy' end as status,
      case when total = 0 then 'unknown' when connected > 0 then 'healthy' else 'unhealthy' end as websocket,
      total, connected, total - connected as disconnected
    from ws, (values ('all'), ('without_errors')) as s(scenario)""",
)
def met17(spark, d):
    kind = F.col("event_type")
    parts = v.table(spark, d, "events").select(
        kind.alias("name"),
        F.when(kind == "error", "unhealthy").when(kind == "view", "disabled").otherwise("healthy").alias("status"),
    )
    clients = counts.latest_status(v.status_log(spark, d)).withColumn("connected", F.col("status") == "Connected")
    whole = metrics.health(parts, clients).withColumn("scenario", F.lit("all"))
    rest = metrics.health(parts.where("status <> 'unhealthy'"), clients)
    return whole.unionByName(rest.withColumn("scenario", F.lit("without_errors")))


_CLIENTS = v.LOG + """, ps as (select case when user_id % 2 = 0 then 'Binance' else 'Kraken' end as exchange,
      upper(event_type) as symbol, cast(floor(epoch(ts) / 3600) as bigint) as sec, count(*) as n
    from events group by all),
  st as (select exchange, max_by(status, seq) as status from lg group by 1),
  cr as (select exchange, exchange || '_' || symbol as name, symbol, status = 'Connected' as connected,
    coalesce(cast(sum(case when sec > 473960 - 10 and sec <= 473960 then n end) as double)
      / count(case when sec > 473960 - 10 and sec <= 473960 then n end), 0) as rate,
    cast(sum(n) as bigint) as messages
  from ps join st using (exchange) group by exchange, symbol, status)"""


def _clients(spark, d):
    hour = F.floor(F.unix_seconds("ts") / 3600).cast("bigint").alias("sec")
    per = v.ticks(spark, d).groupBy("exchange", "ticker", hour).agg(F.count("*").alias("n"))
    return metrics.client_rows(per, v.status_log(spark, d), at=473960)


@query("met18_client_rows", _CLIENTS + "select * from cr")
def met18_rows(spark, d):
    return _clients(spark, d)


@query(
    "met18_client_summary",
    _CLIENTS
    + """select round(sum(rate), 6) as incoming_rate, count_if(connected) as connected,
      count_if(not connected) as disconnected from cr""",
)
def met18(spark, d):
    return metrics.client_summary(_clients(spark, d)).withColumn("incoming_rate", F.round("incoming_rate", 6))


@query(
    "met19_drop_warning",
    v.HEALTH
    + """select ts, channel, incoming, received, queued, incoming - received as backlog,
      greatest(incoming - received - queued, 0) as dropped from hs where incoming - received - queued > 10""",
)
def met19(spark, d):
    return metrics.drop_warnings(v.health_samples(spark, d), 10)


@query(
    "met20_candle_violations",
    v.TK
    + CANDLE_SQL
    + """, sk as (select *, high - 1 as h2, low + 1 as l2 from cd),
    br as (select ticker, exchange, start_time, concat_ws(',',
        case when h2 < open then 'high_below_open' end, case when h2 < close then 'high_below_close' end,
        case when h2 < l2 then 'high_below_low' end, case when l2 > open then 'low_above_open' end,
        case when l2 > close then 'low_above_close' end, case when not (volume > 0) then 'no_volume' end) as broken
      from sk)
    select * from br where broken <> ''""",
)
def met20(spark, d):
    # High and low are moved by one so that there is something to find.
    c = candles.ohlcv(v.ticks(spark, d), 3600)
    one = F.lit(1).cast("decimal(18,8)")
    skewed = c.withColumn("high", F.col("high") - one).withColumn("low", F.col("low") + one)
    return candles.violations(skewed).select("ticker", "exchange", "start_time", "broken")


@query(
    "met20_candles_sound",
    v.TK + CANDLE_SQL + "select ticker, exchange, start_time, 'no_volume' as broken from cd where not (volume > 0)",
)
def met20_sound(spark, d):
    return candles.violations(candles.ohlcv(v.ticks(spark, d), 3600)).select(
        "ticker", "exchange", "start_time", "broken"
    )
