"""Read API, sorts, limits and set operations."""

from datetime import datetime

from pyspark.sql import functions as F

from ticklake.operators import candles, dedup, joins, metrics, reads, runs
from ticklake.plans import views as v
from ticklake.plans.registry import query
from ticklake.session import scratch
from ticklake.sinks.ticks import append, to_rows
from ticklake.sources.tables import read_ticks

FROM, TO = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
_BETWEEN = "ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20 12:00:00'"
_COLS = "trade_id, ticker, exchange, cast(price as double) as price, cast(volume as double) as volume, ts"
_DAY = "ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11'"
_HOUR = "ts >= timestamp '2024-01-10 12:00:00' and ts < timestamp '2024-01-10 13:00:00'"


@query("flt01_by_ticker", v.TK + f"select {_COLS} from tk where ticker = 'CLICK' and {_BETWEEN}")
def flt01(spark, d):
    return reads.by_ticker(v.ticks(spark, d), "CLICK", FROM, TO)


@query("flt02_by_exchange", v.TK + f"select {_COLS} from tk where exchange = 'Kraken' and {_BETWEEN}")
def flt02(spark, d):
    return reads.by_exchange(v.ticks(spark, d), "Kraken", FROM, TO)


CANDLE_SQL = """, cd as (
  select ticker, exchange, '60m' as "interval", min_by(price, trade_id) as open, max(price) as high,
         min(price) as low, max_by(price, trade_id) as close, sum(volume) as volume,
         time_bucket(interval '1 hour', ts) as start_time,
         time_bucket(interval '1 hour', ts) + interval 1 hour as end_time, count(*) as ticks,
         min(trade_id) as first_seq, max(trade_id) as last_seq
  from tk group by ticker, exchange, time_bucket(interval '1 hour', ts))"""
CANDLE_OUT = """select ticker, exchange, "interval", cast(open as double) as open, cast(high as double) as high,
  cast(low as double) as low, cast(close as double) as close, cast(volume as double) as volume,
  start_time, end_time, ticks, first_seq, last_seq from cd"""


@query(
    "flt03_candles",
    v.TK + CANDLE_SQL + CANDLE_OUT + f""" where ticker = 'CLICK' and "interval" = '60m'
    and {_BETWEEN.replace('ts ', 'start_time ')}""",
)
def flt03(spark, d):
    return reads.candles_by_interval(candles.ohlcv(v.ticks(spark, d), 3600), "CLICK", "60m", FROM, TO)


@query("flt04_predicate", v.TK + f"select {_COLS} from tk where price > 50 and volume < 0.5")
def flt04(spark, d):
    return reads.find(v.ticks(spark, d), (F.col("price") > 50) & (F.col("volume") < F.lit("0.5").cast("decimal(3,1)")))


@query("udf02_predicate_sql", v.TK + f"select {_COLS} from tk where price > 50 or ticker = 'VIEW'")
def udf02(spark, d):
    return reads.find(v.ticks(spark, d), "price > 50 or ticker = 'VIEW'")


@query("flt05_by_id", v.TK + f"select {_COLS} from tk where trade_id = 77")
def flt05(spark, d):
    return reads.by_id(v.ticks(spark, d), 77, "trade_id")


@query(
    "flt06_unnormalized",
    v.TK + f"select {_COLS} from tk where not (volume >= 0.5) order by ts limit 1000",
)
def flt06(spark, d):
    t = v.ticks(spark, d).withColumn("normalized", F.col("volume") >= F.lit("0.5").cast("decimal(3,1)"))
    return reads.unnormalized(t, 1000).drop("normalized")


@query(
    "flt07_exists",
    v.AR
    + """, asked as (select distinct ticker, 'Binance' as exchange, ts from ar)
    select a.ticker, a.ts, s.ticker is not null as found from asked a
    left join (select distinct ticker, ts from ar where exchange = 'Binance') s using (ticker, ts)""",
)
def flt07(spark, d):
    # The one-key form returns a boolean; asked of every key at once it is a join.
    ar = v.arrivals(spark, d)
    asked = ar.select("ticker", F.lit("Binance").alias("exchange"), "ts").distinct()
    found = joins.existing_keys(ar, asked).withColumn("found", F.lit(True))
    return asked.join(found, ["ticker", "exchange", "ts"], "left").select(
        "ticker", "ts", F.coalesce("found", F.lit(False)).alias("found")
    )


TICK_COLUMNS = ["trade_id", "ticker", "exchange", "price", "volume", "ts"]


def _by_day(spark, d):
    """The ticks as the day-partitioned table holds them."""
    path = scratch(spark, "rq")
    append(to_rows(v.ticks(spark, d)), path)
    return read_ticks(spark, path)


@query("rq_full_scan", v.TK + f"select {_COLS} from tk where ticker = 'CLICK'")
def flt08(spark, d):
    return reads.find(_by_day(spark, d), F.col("ticker") == "CLICK").select(*TICK_COLUMNS)


@query("rq_range_1d", v.TK + f"select {_COLS} from tk where ticker = 'CLICK' and {_DAY}")
def flt09_day(spark, d):
    return reads.ticker_range(_by_day(spark, d), "CLICK", *v.DAY).select(*TICK_COLUMNS)


@query("rq_range_1h", v.TK + f"select {_COLS} from tk where ticker = 'CLICK' and {_HOUR}")
def flt09_hour(spark, d):
    return reads.ticker_range(_by_day(spark, d), "CLICK", *v.HOUR).select(*TICK_COLUMNS)


@query("rq_count_range", v.TK + f"select count(*) as n from tk where ticker = 'CLICK' and {_DAY}")
def agg04(spark, d):
    return reads.count_range(_by_day(spark, d), "CLICK", *v.DAY)


@query("rq_topn_1000", v.TK + f"select {_COLS} from tk where ticker = 'CLICK' order by ts desc, trade_id limit 1000")
def srt03(spark, d):
    return reads.newest(_by_day(spark, d), "CLICK", 1000).select(*TICK_COLUMNS)


@query(
    "flt10_metric_filter",
    v.GAUGE
    + """select metric, exchange, ts, cast(value as double) as value from ga
    where not regexp_matches(metric, '^click|^view') and exchange = 'Kraken'""",
)
def flt10(spark, d):
    g = v.gauges(spark, d).withColumn("labels", F.concat(F.lit('exchange="'), "exchange", F.lit('"')))
    return metrics.select_metrics(g, exclude="^click|^view", label='exchange="Kraken"').select(
        "metric", "exchange", "ts", "value"
    )


@query(
    "flt11_metric_prefix",
    v.SCRAPE
    + """select metric || '{' || labels || '} ' || case value when 'Inf' then '+Inf' else value end as line from sc
    where kind = 'purchase' order by trade_id limit 1""",
)
def flt11(spark, d):
    return reads.first_by_prefix(v.scrape_lines(spark, d), "purchase_total").select("line")


@query("srt01_order_by_time", v.TK + f"select {_COLS} from tk order by ts")
def srt01(spark, d):
    return v.ticks(spark, d).orderBy("ts")


@query("srt02_oldest", v.TK + f"select {_COLS} from tk order by ts, trade_id limit 1000")
def srt02(spark, d):
    return reads.unnormalized(to_rows(v.ticks(spark, d)), 1000).select(*TICK_COLUMNS)


@query(
    "srt04_report_order",
    v.RUNS
    + """select method, mode, chunk_size, run_id, row_number() over (
      order by method, case when mode = 'Sequential' then 0 else 1 end, chunk_size, run_id) as place from rn""",
)
def srt04(spark, d):
    from ticklake.operators import ordered

    r = v.runs(spark, d)
    # The place of each row, so that the order itself is compared.
    rank = F.when(F.col("mode") == "Sequential", 0).otherwise(1)
    groups = r.groupBy("method", "mode", "chunk_size").agg(F.count("*").alias("n"))
    first = ordered.running_sum(
        groups.withColumn("rank", rank), [], ["method", "rank", "chunk_size"], {"upto": F.col("n")},
        F.lit(0).cast("bigint"),
    ).select("method", "mode", "chunk_size", (F.col("upto") - F.col("n")).alias("before"))
    inside = ordered.row_numbers(
        r.select("method", "mode", "chunk_size", "run_id"), ["method", "mode", "chunk_size"], ["run_id"], "i",
        ordered.seq_chunk("run_id"),
    )
    placed = inside.join(first, ["method", "mode", "chunk_size"])
    return runs.report_order(placed).select(
        "method", "mode", "chunk_size", "run_id", (F.col("before") + F.col("i")).alias("place")
    )


@query(
    "srt05_metric_order",
    v.GAUGE + "select metric, exchange, ts, cast(value as double) as value from ga order by metric, exchange",
)
def srt05(spark, d):
    # The time breaks ties, so that the rows of one metric do not all sort in one task.
    return v.gauges(spark, d).select("metric", "exchange", "ts", "value").orderBy("metric", "exchange", "ts")


@query(
    "srt06_first_last_sample",
    v.BATCH
    + """select ts, channel, batch_size from bl
    where ts = (select min(ts) from bl) or ts = (select max(ts) from bl)""",
)
def srt06(spark, d):
    return metrics.first_and_last(v.batches(spark, d)).select("ts", "channel", "batch_size")


@query("set01_distinct_keys", v.AR + "select distinct ticker, exchange, ts from ar")
def set01(spark, d):
    return dedup.distinct_keys(v.arrivals(spark, d))
