"""Scalar functions over the whole tables."""

from pyspark.sql import functions as F

from ticklake.functions import scalars as s
from ticklake.functions import sql as sqlf
from ticklake.plans import views as v
from ticklake.plans.registry import query


@query(
    "f01_truncate",
    """with p as (
      select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice as e,
             cast(cast(round(l_extendedprice * 100) as hugeint) * cast(round(l_extendedprice * 100) as hugeint)
                  as double) / 10000 as d from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_quantity,
           least(d, cast(9999999999.99999999 as double)) as clamped,
           -least(d, cast(9999999999.99999999 as double)) as clamped_neg, floor(e) as plain
    from p""",
)
def f01(spark, d):
    e = F.col("l_extendedprice").cast("decimal(18,4)")
    wide = (e * e).cast("decimal(38,14)")
    return v.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        s.truncate_price(wide).alias("clamped"),
        s.truncate_price(-wide).alias("clamped_neg"),
        F.floor(s.truncate_price(e.cast("decimal(38,14)"))).cast("double").alias("plain"),
    )


@query(
    "f01_truncate_digits",
    """select l_orderkey, l_linenumber, l_partkey, l_quantity,
      cast(cast(l_extendedprice * 100 as bigint) // 100 as double) as whole,
      cast(-(cast(l_extendedprice * 100 as bigint) // 100) as double) as whole_neg
      from lineitem""",
)
def f01_digits(spark, d):
    # Price in units of 1e-10: the two digits after the eighth are cut, in both directions.
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")
    tiny = (cents * F.lit("0.0000000001").cast("decimal(12,10)")).cast("decimal(38,10)")
    scale = F.lit(100000000).cast("double")
    return v.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        F.round(s.truncate_price(tiny).cast("double") * scale).alias("whole"),
        F.round(s.truncate_price(-tiny).cast("double") * scale).alias("whole_neg"),
    )


@query("f02_long_text", v.TK + "select trade_id, cast(price as double) as price from tk")
def f02_long(spark, d):
    text = F.concat(F.repeat(F.lit("0"), 300), F.col("price").cast("string"))
    return v.ticks(spark, d).select("trade_id", s.parse_decimal(text).alias("price"))


@query(
    "f02_parse_decimal",
    v.TK
    + """, x as (
      select trade_id, ticker, price, case ticker
        when 'CLICK' then ' ' || cast(price as varchar) || ' '
        when 'VIEW' then '-1,' || lpad(cast(cast(floor(price) as integer) as varchar), 3, '0') || '.5'
        when 'SIGNUP' then cast(price as varchar) || 'e3'
        when 'PURCHASE' then cast(price as varchar) || '-'
        else 'n/a' end as txt from tk)
    select trade_id, txt, cast(case ticker when 'CLICK' then price
        when 'VIEW' then cast(replace(txt, ',', '') as decimal(18,8))
        when 'PURCHASE' then -price else 0 end as double) as number from x""",
)
def f02(spark, d):
    p = F.col("price")
    text = (
        F.when(F.col("ticker") == "CLICK", F.concat(F.lit(" "), p.cast("string"), F.lit(" ")))
        .when(
            F.col("ticker") == "VIEW",
            F.concat(F.lit("-1,"), F.lpad(F.floor(p).cast("int").cast("string"), 3, "0"), F.lit(".5")),
        )
        .when(F.col("ticker") == "SIGNUP", F.concat(p.cast("string"), F.lit("e3")))
        .when(F.col("ticker") == "PURCHASE", F.concat(p.cast("string"), F.lit("-")))
        .otherwise("n/a")
    )
    return v.ticks(spark, d).select("trade_id", text.alias("txt")).withColumn(
        "number", s.parse_decimal(F.col("txt"))
    )


@query(
    "f03_epoch_millis",
    """select event_id, date_trunc('milliseconds', ts) as at,
      case when event_type = 'error' then timestamp '1970-01-01' else date_trunc('milliseconds', ts) end as at_or_epoch
      from events""",
)
def f03(spark, d):
    e = v.table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id",
        s.millis_to_ts(ms).alias("at"),
        s.millis_to_ts(F.when(F.col("event_type") != "error", ms)).alias("at_or_epoch"),
    )


def _bucket_sql(step: int) -> str:
    us, shift = step * 1_000_000, 62135596800 * 1_000_000
    return f"make_timestamp(epoch_us(ts) - ((epoch_us(ts) + {shift}) % {us}))"


@query(
    "f04_bucket_start",
    f"""select event_id, {_bucket_sql(7)} as b7, {_bucket_sql(60)} as b60,
        {_bucket_sql(2700)} as b2700, {_bucket_sql(100000)} as b100000,
        {_bucket_sql(7)} + interval 7 second as e7 from events""",
)
def f04(spark, d):
    ts = F.col("ts").cast("timestamp")
    return v.table(spark, d, "events").select(
        "event_id",
        *[s.bucket_start(ts, n).alias(f"b{n}") for n in (7, 60, 2700, 100000)],
        (s.bucket_start(ts, 7) + F.expr("interval 7 seconds")).alias("e7"),
    )


@query(
    "f04_bucket_window",
    f"""select {_bucket_sql(100000)} as start_time, {_bucket_sql(100000)} + interval 100000 second as end_time,
        count(*) as n from events group by 1, 2""",
)
def f04_window(spark, d):
    ts = F.col("ts").cast("timestamp")
    return (
        v.table(spark, d, "events")
        .groupBy(s.bucket_window(ts, 100000).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n")
    )


@query(
    "f05_interval_label",
    """with x as (select o_orderkey, o_custkey % 4000 + 1 as secs, (o_custkey % 60 + 1) * 60 as mins from orders)
    select o_orderkey,
      case when secs >= 60 and secs % 60 = 0 then (secs // 60)::varchar || 'm' else secs::varchar || 's' end as label,
      case when mins >= 60 and mins % 60 = 0 then (mins // 60)::varchar || 'm' else mins::varchar || 's' end as minutes
    from x""",
)
def f05(spark, d):
    return v.table(spark, d, "orders").select(
        "o_orderkey",
        s.interval_label(F.col("o_custkey") % 4000 + 1).alias("label"),
        s.interval_label((F.col("o_custkey") % 60 + 1) * 60).alias("minutes"),
    )


@query(
    "f06_uuid",
    """select event_id as trade_id, lpad(lower(to_hex(epoch_ms(date_trunc('milliseconds', ts)))), 12, '0') as at,
      '7' as version, true as v7_shape, true as v4_shape from events""",
)
def f06(spark, d):
    # Random by nature: time prefix, version and shape are what can be compared.
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-%s[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    made = v.ticks(spark, d).select("trade_id", s.uuid7(F.col("ts")).alias("u7"), s.uuid4().alias("u4"))
    return made.select(
        "trade_id",
        F.concat(F.substring("u7", 1, 8), F.substring("u7", 10, 4)).alias("at"),
        F.substring("u7", 15, 1).alias("version"),
        F.col("u7").rlike(shape % "7").alias("v7_shape"),
        F.col("u4").rlike(shape % "4").alias("v4_shape"),
    )


STABLE_HASH = """list_reduce(list_prepend(cast(17 as bigint),
      list_transform(string_split({0}, ''), lambda c: cast(ascii(c) as bigint))),
      lambda a, c: (a * 31 + c) & 4294967295) & 2147483647"""


@query(
    "f07_shard",
    f"""select c_custkey, {STABLE_HASH.format('c_name')} as hash, cast(({STABLE_HASH.format('c_name')}) % 4 as integer) as shard
        from customer""",
)
def f07(spark, d):
    return v.table(spark, d, "customer").select(
        "c_custkey", s.stable_hash(F.col("c_name")).alias("hash"), s.shard(F.col("c_name"), 4).alias("shard")
    )


# A character beyond the basic plane is two units of the hash.
@query(
    "f07_supplementary",
    f"""select c_custkey, ((({STABLE_HASH.format('c_name')}) * 31 + 55357) * 31 + 56832) % 2147483648 as hash
        from customer""",
)
def f07_supplementary(spark, d):
    name = F.concat("c_name", F.lit("\U0001f600"))
    return v.table(spark, d, "customer").select("c_custkey", s.stable_hash(name).alias("hash"))


@query(
    "f08_exchange_tag",
    """with x as (select event_id, case user_id % 4 when 0 then 'Binance' when 1 then 'Kraken'
          when 2 then 'binance' else 'Other' end as exchange from events)
    select event_id, exchange,
      case exchange when 'Binance' then 'binance' when 'Kraken' then 'kraken' else exchange end as raw,
      case exchange when 'Binance' then 'binance' when 'Kraken' then 'kraken' else 'unknown' end as strict,
      case lower(exchange) when 'binance' then 'binance' when 'kraken' then 'kraken' else 'unknown' end as loose
    from x""",
)
def f08(spark, d):
    kind = F.col("user_id") % 4
    name = F.when(kind == 0, "Binance").when(kind == 1, "Kraken").when(kind == 2, "binance").otherwise("Other")
    x = F.col("exchange")
    return v.table(spark, d, "events").select("event_id", name.alias("exchange")).select(
        "event_id",
        "exchange",
        s.exchange_tag(x).alias("raw"),
        s.exchange_tag(x, "unknown").alias("strict"),
        s.exchange_tag(x, "unknown", ignore_case=True).alias("loose"),
    )


@query(
    "f09_status_message",
    v.LOG
    + """select seq, status as event_type, coalesce(case status when 'Connected' then 'Connected to ' || exchange
        when 'Disconnected' then 'Disconnected from ' || exchange
        else coalesce(message, 'Error on ' || exchange) end, '') as message from lg""",
)
def f09(spark, d):
    log = v.status_log(spark, d)
    text = s.connection_message(F.col("exchange"), F.col("status"), F.col("message"))
    return log.select("seq", F.col("status").alias("event_type"), F.coalesce(text, F.lit("")).alias("message"))


@query(
    "f10_message_key",
    v.TK + "select trade_id, ticker || ':' || exchange as key, exchange || '_' || ticker as client from tk",
)
def f10(spark, d):
    t = v.ticks(spark, d)
    return t.select(
        "trade_id",
        s.message_key(F.col("ticker"), F.col("exchange")).alias("key"),
        s.client_name(F.col("exchange"), F.col("ticker")).alias("client"),
    )


@query(
    "f11_subscribe",
    """select c_custkey, lower(c_name) as lo, upper(c_name) as up,
      '{"method":"SUBSCRIBE","params":["' || lower(c_name) || '@trade"],"id":1}' as message from customer""",
)
def f11(spark, d):
    return v.table(spark, d, "customer").select(
        "c_custkey",
        F.lower("c_name").alias("lo"),
        F.upper("c_name").alias("up"),
        s.subscribe_message(F.col("c_name")).alias("message"),
    )


@query(
    "f12_partition_name",
    """with x as (select o_orderkey, o_orderdate, case when o_orderstatus = 'P' then 'rawticks_default'
         else 'rawticks_' || strftime(o_orderdate, '%Y_%m_%d') end as name from orders)
    select o_orderkey, name, cast(case when name <> 'rawticks_default'
      then cast(o_orderdate as date) end as varchar) as day from x""",
)
def f12(spark, d):
    name = F.when(F.col("o_orderstatus") == "P", "rawticks_default").otherwise(
        s.partition_name("rawticks", F.col("o_orderdate"))
    )
    return (
        v.table(spark, d, "orders")
        .select("o_orderkey", name.alias("name"))
        .withColumn("day", s.partition_day("rawticks", F.col("name")))
    )


@query(
    "f13_metric_value",
    v.TK
    + """, x as (select trade_id, ticker, price, case ticker when 'CLICK' then 'NaN' when 'VIEW' then '+Inf'
          when 'SIGNUP' then '-inf' when 'ERROR' then cast(cast(price as decimal(18,2)) as varchar) || 'e2'
          else cast(price as varchar) end as txt from tk)
    select trade_id, case ticker when 'CLICK' then 'NaN' when 'VIEW' then 'Inf' when 'SIGNUP' then '-Inf'
        else txt end as shown,
      cast(case ticker when 'ERROR' then price * 100 when 'PURCHASE' then price end as double) as number from x""",
)
def f13(spark, d):
    p = F.col("price")
    text = (
        F.when(F.col("ticker") == "CLICK", "NaN")
        .when(F.col("ticker") == "VIEW", "+Inf")
        .when(F.col("ticker") == "SIGNUP", "-inf")
        .when(F.col("ticker") == "ERROR", F.concat(p.cast("decimal(18,2)").cast("string"), F.lit("e2")))
        .otherwise(p.cast("string"))
    )
    number = s.metric_value(F.col("txt"))
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return v.ticks(spark, d).select("trade_id", text.alias("txt")).select(
        "trade_id", s.normalise_value_text(F.col("txt")).alias("shown"), F.when(finite, number).alias("number")
    )


@query(
    "f14_label_pairs",
    v.TK
    + """select trade_id, 'exchange=' || lower(exchange) || '; id=' || trade_id as pairs,
      lower(exchange) as exchange, cast(trade_id as varchar) as id from tk""",
)
def f14(spark, d):
    text = F.concat(
        F.lit('exchange="'), F.lower("exchange"), F.lit('",id="'), F.col("trade_id").cast("string"), F.lit('"')
    )
    rows = v.ticks(spark, d).select("trade_id", text.alias("l"))
    return rows.select(
        "trade_id",
        s.label_pairs(F.col("l")).alias("pairs"),
        s.label_map(F.col("l"))["exchange"].alias("exchange"),
        s.label_map(F.col("l"))["id"].alias("id"),
    )


@query(
    "f14_repeated_label",
    v.TK + "select trade_id, 'a \"b\" {' || trade_id || '}' as id from tk",
)
def f14_repeated(spark, d):
    # The last of two values counts; quotes inside a value are escaped.
    text = F.concat(F.lit('id="x",id="a \\"b\\" {'), F.col("trade_id").cast("string"), F.lit('}"'))
    return v.ticks(spark, d).select("trade_id", s.label_map(text)["id"].alias("id"))


@query(
    "f15_fill_percent",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
      round(case when cap > 0 then cast(n as double) / cap * 100 else 0 end, 1) as fill
      from (select *, cast(l_quantity as bigint) as n, case when l_linestatus = 'O' then 64 else 0 end as cap
            from lineitem)""",
)
def f15(spark, d):
    cap = F.when(F.col("l_linestatus") == "O", 64).otherwise(0)
    return v.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        s.fill_percent(F.col("l_quantity").cast("bigint"), cap).alias("fill"),
    )


@query(
    "f16_csv_quote",
    """select event_id, '"' || replace(props, '"', '""') || '"' as quoted from events""",
)
def f16(spark, d):
    return v.table(spark, d, "events").select("event_id", s.csv_quote(F.col("props")).alias("quoted"))


_CANDLE_JSON = """
    select ticker || ':' || exchange as key, ticker, '60m' as "interval", exchange,
           cast(min_by(price, trade_id) as double) as open, cast(max(price) as double) as high,
           cast(min(price) as double) as low, cast(max_by(price, trade_id) as double) as close,
           cast(sum(volume) as double) as volume,
           time_bucket(interval '1 hour', ts) as start_time,
           time_bucket(interval '1 hour', ts) + interval 1 hour as end_time
    from tk group by ticker, exchange, time_bucket(interval '1 hour', ts)"""


@query("f17_candle_json", v.TK + _CANDLE_JSON)
def f17(spark, d):
    from ticklake.operators.candles import ohlcv
    from ticklake.sources.candle_topic import decode, encode

    sent = encode(ohlcv(v.ticks(spark, d), 3600))
    back, _ = decode(sent.select("key", "value"))
    return back.withColumn("key", s.message_key(F.col("ticker"), F.col("exchange"))).select(
        "key", "ticker", "interval", "exchange", "open", "high", "low", "close", "volume", "start_time", "end_time"
    )


@query(
    "f18_required",
    v.LOG
    + """select seq, message is not null as complete, coalesce(message, '') as message from lg""",
)
def f18(spark, d):
    return v.status_log(spark, d).select(
        "seq",
        s.required("exchange", "message").alias("complete"),
        F.coalesce("message", F.lit("")).alias("message"),
    )


@query(
    "udf04_sql_functions",
    v.TK
    + f"""select trade_id, cast(price as double) as price,
      case when k >= 60 and k % 60 = 0 then (k // 60)::varchar || 'm' else k::varchar || 's' end as label,
      cast(({STABLE_HASH.format('ticker')}) % 3 as integer) as shard,
      cast(price as double) as parsed, -cast(price as double) as negative
    from (select *, cast(volume * 100 as integer) + 1 as k from tk)""",
)
def udf04(spark, d):
    sqlf.register(spark)
    return v.ticks(spark, d).selectExpr(
        "trade_id",
        "tick_truncate(CAST(price AS DECIMAL(38,14))) AS price",
        "tick_interval_label(CAST(volume * 100 AS INT) + 1) AS label",
        "tick_shard(ticker, 3) AS shard",
        "tick_parse_decimal(CAST(price AS STRING)) AS parsed",
        "tick_parse_decimal(concat(repeat('0', 300), CAST(price AS STRING), '-')) AS negative",
    )
