"""Joins the pipeline performs."""

from pyspark.sql import functions as F

from ticklake.operators import counts, dedup, joins, metrics, runs
from ticklake.plans import views as v
from ticklake.plans.registry import query


@query(
    "join01_missing_keys",
    v.FIRST
    + """select fa.ticker, fa.exchange, fa.ts, trade_id, cast(price as double) as price
    from fa where not exists (
      select 1 from ar s where s.ticker = fa.ticker and s.exchange = fa.exchange and s.ts = fa.ts
        and s.price > 50)""",
)
def join01(spark, d):
    ar = v.arrivals(spark, d)
    stored = dedup.first_arrival(ar.where(F.col("price") > 50))
    return joins.missing_keys(dedup.first_arrival(ar), stored).select(
        "ticker", "exchange", "ts", "trade_id", "price"
    )


@query(
    "join02_existing_keys",
    v.AR
    + """select distinct ticker, exchange, ts from ar where price > 50
    intersect select ticker, exchange, ts from ar where volume > 0.5""",
)
def join02(spark, d):
    ar = v.arrivals(spark, d)
    half = F.lit("0.5").cast("decimal(3,1)")
    return joins.existing_keys(ar.where(F.col("price") > 50), ar.where(F.col("volume") > half))


@query(
    "join02_existing_keys_loose",
    v.AR
    + """, asked as (select * from ar where volume > 0.9 and exchange = 'Kraken')
    select distinct ticker, exchange, ts from ar where price > 50
      and ticker in (select ticker from asked) and exchange in (select exchange from asked)
      and ts in (select ts from asked)""",
)
def join02_loose(spark, d):
    ar = v.arrivals(spark, d)
    most = F.lit("0.9").cast("decimal(3,1)")
    asked = ar.where((F.col("volume") > most) & (F.col("exchange") == "Kraken"))
    return joins.existing_keys(ar.where(F.col("price") > 50), asked, loose=True)


@query(
    "join03_subscriptions",
    """with rd as (select distinct 'NATION_' || (user_id % 30) as exchange, lower(event_type) as symbol from events)
    select exchange, symbol, 'wss://' || lower(n_name) || '.example/ws/' || symbol || '@trade' as url
    from rd join nation on n_name = exchange""",
)
def join03(spark, d):
    readers = (
        v.table(spark, d, "events")
        .select(
            F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("exchange"),
            F.lower("event_type").alias("symbol"),
        )
        .distinct()
    )
    exchanges = v.table(spark, d, "nation").select(
        F.col("n_name").alias("exchange"),
        F.concat(F.lit("wss://"), F.lower("n_name"), F.lit(".example/ws/{Symbol}@trade")).alias("url"),
    )
    return joins.subscriptions(readers, exchanges)


@query(
    "join03_enrich_ticks",
    """select n_name as exchange, n_regionkey as region, count(*) as ticks,
      cast(sum(cast(value as decimal(18,8))) as double) as turnover
    from events join nation on n_name = 'NATION_' || (user_id % 30) group by 1, 2""",
)
def join03_ticks(spark, d):
    t = v.table(spark, d, "events").select(
        F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("exchange"),
        F.col("value").cast("decimal(18,8)").alias("price"),
    )
    exchanges = v.table(spark, d, "nation").select(
        F.col("n_name").alias("exchange"), F.col("n_regionkey").alias("region")
    )
    # Counted first, so that the join sees one row per exchange.
    per = t.groupBy("exchange").agg(F.count("*").alias("ticks"), F.sum("price").alias("turnover"))
    return joins.lookup(per, exchanges, ["exchange"]).select("exchange", "region", "ticks", "turnover")


_ABOUT = """, about as (
  select scrape, case when kind = 'error' then 'error_ms' else metric end as name,
         max_by('Total of ' || trade_id, trade_id) as description, 'counter' as type
  from sc where kind not in ('signup', 'view') group by all)
select sc.scrape, sc.trade_id * 10 + 2 as line_no, sc.metric, sc.labels, sc.value,
       coalesce(about.type, '') as type, coalesce(about.description, '') as description
from sc left join about on about.scrape = sc.scrape and about.name = {0}
where kind <> 'signup'"""


@query("join04_help_and_type", v.SCRAPE + _ABOUT.format("regexp_replace(sc.metric, '_(bucket|sum|count)$', '')"))
def join04(spark, d):
    from ticklake.sources.metrics_text import samples

    return samples(v.scrape_lines(spark, d)).select(
        "scrape", "line_no", "metric", "labels", "value", "type", "description"
    )


@query("join04_help_and_type_strict", v.SCRAPE + _ABOUT.format("sc.metric"))
def join04_strict(spark, d):
    from ticklake.sources.metrics_text import samples

    return samples(v.scrape_lines(spark, d), strict_name=True).select(
        "scrape", "line_no", "metric", "labels", "value", "type", "description"
    )


_TIMES = v.RUNS + """, tm as (
  select label, test_name, sum(elapsed_ms) as total, count(*) as n from rn group by all
), cmp as (
  select a.test_name, cast(a.total as double) / a.n as base, cast(b.total as double) / b.n as other
  from tm a join tm b using (test_name) where a.label = 'O' and b.label = 'F')"""


@query(
    "join05_compare_runs",
    _TIMES + "select test_name, base, other, case when base > 0 then base / other else 0 end as speedup from cmp",
)
def join05(spark, d):
    r = v.runs(spark, d)
    base = runs.timings(r.where(F.col("label") == "O"))
    return joins.compare_runs(base, runs.timings(r.where(F.col("label") == "F")))


@query(
    "met16_run_comparison",
    _TIMES
    + """select test_name, base, other, case when base > 0 then other / base else 0 end as ratio,
      case when other > base then 'up' when other < base then 'down' else 'same' end as change from cmp""",
)
def met16(spark, d):
    r = v.runs(spark, d)

    def side(label):
        return runs.timings(r.where(F.col("label") == label)).select("test_name", F.col("avg_ms").alias("value"))

    return metrics.compare_metrics(side("O"), side("F"), ["test_name"])


@query(
    "join06_partitions",
    v.TK + "select 'rawticks_' || strftime(ts, '%Y_%m_%d') as name, count(*) as rows from tk group by 1",
)
def join06(spark, d):
    from ticklake.functions import partition_name

    t = v.ticks(spark, d).withColumn("dt", F.to_date("ts"))
    return t.groupBy("dt").agg(F.count("*").alias("rows")).select(
        partition_name("rawticks", F.col("dt")).alias("name"), "rows"
    )


_REPORT = v.LOG + """, st as (select exchange, max_by(status, seq) as status from lg group by 1)"""


@query(
    "join07_status_report",
    _REPORT
    + """select exchange, status, coalesce(n, 0) as ticks from st left join (
      select case when user_id % 2 = 0 then 'Binance' else 'Kraken' end as exchange, count(*) as n
      from events where event_type = 'click' and user_id % 2 = 0 group by 1) using (exchange)""",
)
def join07(spark, d):
    t = v.ticks(spark, d).where((F.col("ticker") == "CLICK") & (F.col("exchange") == "Binance"))
    return counts.status_report(v.status_log(spark, d), t)


@query(
    "join07_status_report_all",
    _REPORT
    + """select exchange, status, coalesce(n, 0) as ticks from st left join (
      select case when user_id % 2 = 0 then 'Binance' else 'Kraken' end as exchange, count(*) as n
      from events group by 1) using (exchange)""",
)
def join07_all(spark, d):
    """The whole report; join07_status_report is the case of an exchange without ticks."""
    return counts.status_report(v.status_log(spark, d), v.ticks(spark, d))
