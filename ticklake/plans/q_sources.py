"""Sources: wire messages, metric text, files."""

from pyspark.sql import functions as F

from ticklake.plans import views as v
from ticklake.plans.registry import query
from ticklake.session import scratch
from ticklake.sources import candle_topic, messages, metrics_text, tables

_TICKS = """select seq as trade_id, ticker, 'Binance' as exchange, cast(price as double) as price,
  cast(volume as double) as volume, ts from parsed where status = 'tick'"""


@query("src01_trade_messages", v.MSG + _TICKS)
def src01(spark, d):
    return messages.ticks(messages.parse(v.messages(spark, d), "Binance"))


@query(
    "src01_dead_letters",
    v.MSG + "select seq, 'Binance' as exchange, reason, '{broken ' || seq as value from parsed where status = 'dead'",
)
def src01_dead(spark, d):
    return messages.dead_letters(messages.parse(v.messages(spark, d), "Binance"))


@query("src01_outcomes", v.MSG + "select status, reason, count(*) as n from parsed group by all")
def src01_outcomes(spark, d):
    parsed = messages.parse(v.messages(spark, d), "Binance")
    return parsed.groupBy("m.status", "m.reason").agg(F.count("*").alias("n"))


@query(
    "src01_strict",
    v.MSG
    + """select seq, case when ticker = 'VIEW' then 'incomplete' else reason end as reason from parsed
    where status = 'dead' or (ticker = 'VIEW' and status = 'tick')""",
)
def src01_strict(spark, d):
    parsed = messages.parse(v.messages(spark, d), "Binance", strict=True)
    return messages.dead_letters(parsed).select("seq", "reason")


_KRAKEN = """select trade_id as seq, ticker as symbol, cast(price as double) as price,
  cast(volume as double) as qty, {side} as side, cast(trade_id as varchar) as trade_id, 'N/A' as timestamp
  from tk {join} where ticker not in ('ERROR', 'SIGNUP')"""


def _typed(rows):
    return rows.withColumn("price", F.col("price").cast("double")).withColumn("qty", F.col("qty").cast("double"))


@query("src02_kraken_first", v.TK + _KRAKEN.format(side="'buy'", join=""))
def src02(spark, d):
    return _typed(messages.kraken_fields(v.kraken_messages(spark, d)))


@query(
    "src02_kraken_every",
    v.TK + _KRAKEN.format(side="s.side", join=", (values ('buy'), ('sell')) as s(side)"),
)
def src02_every(spark, d):
    return _typed(messages.kraken_fields(v.kraken_messages(spark, d), every=True))


@query(
    "src02_kraken_ticks",
    v.TK
    + """select trade_id * 1048576 + pos as trade_id, ticker, 'Kraken' as exchange, cast(price as double) as price,
      cast(volume as double) as volume, timestamp '1970-01-01' as ts
    from tk, (values (0), (1)) as s(pos) where ticker not in ('ERROR', 'SIGNUP')""",
)
def src02_ticks(spark, d):
    # Every trade of a message is a tick of its own.
    return messages.ticks(messages.parse(v.kraken_messages(spark, d), "Kraken"), "seq")


@query(
    "src03_without_heartbeat",
    v.TK + "select trade_id as seq from tk where ticker <> 'ERROR'",
)
def src03(spark, d):
    return messages.without_keepalive(v.kraken_messages(spark, d)).select("seq")


@query(
    "src04_field_extract",
    v.MSG
    + """select p.seq, case when status = 'tick' or reason = 'not_a_trade' then p.ticker else 'N/A' end as symbol,
      case when status = 'dead' then 'N/A' when p.ticker = 'VIEW' then 'bad' else cast(tk.price as varchar) end as price,
      case when status = 'dead' then 'N/A' else cast(p.volume as varchar) end as quantity,
      case when status = 'dead' then 'N/A' else cast(epoch_ms(p.ts) as varchar) end as trade_ms,
      case when status <> 'dead' and tk.exchange = 'Binance' then 'seller' else 'buyer' end as initiator
    from parsed p join tk on tk.trade_id = p.seq""",
)
def src04(spark, d):
    return messages.trade_fields(v.messages(spark, d)).select(
        "seq", "symbol", "price", "quantity", "trade_ms", "initiator"
    )


_CANDLES = """ select ticker, exchange, '60m' as "interval", cast(min_by(price, trade_id) as double) as open,
  cast(max(price) as double) as high, cast(min(price) as double) as low,
  cast(max_by(price, trade_id) as double) as close, cast(sum(volume) as double) as volume,
  time_bucket(interval '1 hour', ts) as start_time,
  time_bucket(interval '1 hour', ts) + interval 1 hour as end_time
  from tk group by ticker, exchange, time_bucket(interval '1 hour', ts)"""


@query("src05_candle_topic", v.TK + _CANDLES)
def src05(spark, d):
    from ticklake.operators.candles import ohlcv

    topic = candle_topic.encode(ohlcv(v.ticks(spark, d), 3600)).select(
        "key", F.encode("value", "UTF-8").alias("value")
    )
    return candle_topic.decode(topic)[0]


@query(
    "src07_full_scan",
    v.TK
    + """select trade_id, ticker, exchange, cast(price as double) as price, cast(volume as double) as volume, ts,
      false as normalized, cast(cast(ts as date) as varchar) as dt from tk""",
)
def src07(spark, d):
    from ticklake.sinks.ticks import append, to_rows

    path = scratch(spark, "src07")
    append(to_rows(v.ticks(spark, d)), path)
    return tables.read_ticks(spark, path).drop("id", "received_at")


@query(
    "src08_metric_text",
    v.SCRAPE
    + """select scrape, trade_id * 10 + 2 as line_no, metric, labels, value from sc where kind <> 'signup'""",
)
def src08(spark, d):
    parsed = metrics_text.parse_lines(v.scrape_lines(spark, d))
    return parsed.where("kind = 'sample'").select("scrape", "line_no", "metric", "labels", "value")


@query(
    "src08_line_kinds",
    v.SCRAPE
    + """select kind, cast(sum(n) as bigint) as n from (
      select 'sample' as kind, count(*) as n from sc where kind <> 'signup'
      union all select 'dead', count(*) from sc where kind = 'signup'
      union all select 'comment', count(*) from sc where kind = 'view'
      union all select 'blank', count(*) from sc where kind = 'view'
      union all select 'help', count(*) from sc where kind not in ('signup', 'view')
      union all select 'type', count(*) from sc where kind not in ('signup', 'view')) group by 1""",
)
def src08_kinds(spark, d):
    parsed = metrics_text.parse_lines(v.scrape_lines(spark, d))
    return parsed.groupBy("kind").agg(F.count("*").alias("n"))


_CSV = """select scrape as "Timestamp", metric as "Metric", labels as "Labels", 'counter' as "Type",
  value as "Value", 'says "' || kind || '", twice' as "Description"
  from (select strftime(scrape, '%Y-%m-%dT%H:%M:%S') as scrape, metric, labels, value, kind from sc)"""


def _csv_rows(spark, d):
    lines = metrics_text.parse_lines(v.scrape_lines(spark, d).withColumn("id", F.col("line_no")))
    kind = F.when(F.col("metric") == "error_ms_bucket", "error").otherwise(
        F.regexp_replace("metric", "_total$", "")
    )
    return lines.where("kind = 'sample'").select(
        F.date_format("scrape", "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"),
        F.col("metric").alias("Metric"),
        F.col("labels").alias("Labels"),
        F.lit("counter").alias("Type"),
        F.col("value").alias("Value"),
        F.concat(F.lit('says "'), kind, F.lit('", twice')).alias("Description"),
    )


@query("snk10_metric_csv", v.SCRAPE + _CSV.replace("from sc)", "from sc where kind <> 'signup')"))
def snk10(spark, d):
    path = scratch(spark, "metric-csv")
    metrics_text.write_csv(_csv_rows(spark, d), path)
    return metrics_text.read_csv(spark, path)


@query(
    "src09_metric_csv_typed",
    v.SCRAPE
    + """select metric, exchange, count(*) as n, count(case when value not in ('NaN', 'Inf') then 1 end) as finite
    from (select metric, value, split_part(labels, '"', 2) as exchange from sc where kind <> 'signup')
    group by 1, 2""",
)
def src09(spark, d):
    path = scratch(spark, "metric-csv")
    metrics_text.write_csv(_csv_rows(spark, d), path)
    rows = metrics_text.read_csv(spark, path)
    typed = metrics_text.typed(rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns]))
    finite = ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    return typed.groupBy("metric", F.col("labels")["exchange"].alias("exchange")).agg(
        F.count("*").alias("n"), F.count_if(finite).alias("finite")
    )


_RUN_ROWS = """select method, mode, chunk_size, total_ticks, 1 as chunks, cast(elapsed_ms as double) as elapsed_ms,
  ticks_per_sec from rn"""


def _run_rows(spark, d):
    r = v.runs(spark, d).withColumn("chunks", F.lit(1))
    return r.withColumn("elapsed_ms", F.col("elapsed_ms").cast("double"))


@query("snk11_run_json", v.RUNS + _RUN_ROWS)
def snk11(spark, d):
    path = scratch(spark, "runs")
    tables.write_runs(_run_rows(spark, d), path)
    return tables.read_runs(spark, path)


@query("src10_run_json_totals", v.RUNS + "select mode, count(*) as n, cast(sum(total_ticks) as bigint) as ticks from rn group by 1")
def src10(spark, d):
    path = scratch(spark, "runs")
    tables.write_runs(_run_rows(spark, d), path)
    return tables.read_runs(spark, path).groupBy("mode").agg(
        F.count("*").alias("n"), F.sum("total_ticks").alias("ticks")
    )


@query("udf01_registered_parser", v.TK + "select trade_id, ticker, 'Pipe' as exchange, cast(price as double) as price from tk")
def udf01(spark, d):
    def fields(parts):
        return {
            "unread": F.lit(False),
            "trade": F.lit(True),
            "trade_id": parts[0].cast("bigint"),
            "ticker": parts[1],
            "price": parts[2],
            "volume": F.lit("0"),
            "ts": F.lit(None).cast("timestamp"),
        }

    text = v.ticks(spark, d).select(
        F.concat_ws("|", F.col("trade_id").cast("string"), "ticker", F.col("price").cast("string")).alias("value")
    )
    messages.register_parser("pipe", messages.Parser(lambda value: F.split(value, r"\|"), fields))
    try:
        return messages.ticks(messages.parse(text, "Pipe")).select("trade_id", "ticker", "exchange", "price")
    finally:
        del messages.PARSERS["pipe"]
