"""Scalar functions as Column expressions. All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The storable price range, decimal(18,8).
MAX_PRICE = "9999999999.99999999"
# Fixed value: the largest 96-bit decimal; longer numbers do not parse.
MAX_DECIMAL = "79228162514264337593543950335"
# Fixed value: seconds from 0001-01-01 to 1970-01-01. Candle buckets count from year 1.
YEAR_ONE_SECONDS = -62135596800

# Label of the metric text format: a name, and a quoted value in which a backslash escapes.
LABEL_PATTERN = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'

# sign, integer digits with thousands commas, eight decimals, the rest of them, trailing sign
_NUMBER = r"^\s*([+-]?)((?:[0-9][0-9,]*)?)(?:\.([0-9]{0,8})[0-9]*)?\s*([+-]?)\s*$"
# what nearly every message holds, and a plain cast reads without rounding
_PLAIN_NUMBER = r"^-?[0-9]{1,28}(\.[0-9]{1,8})?$"


def truncate_price(value: Column) -> Column:
    """Cut to eight decimals toward zero and clamp to the storable range."""
    top = F.lit(MAX_PRICE).cast("decimal(18,8)")
    bottom = F.lit("-" + MAX_PRICE).cast("decimal(18,8)")
    cut = F.when(value >= 0, F.floor(value, 8)).otherwise(F.ceil(value, 8))
    return (
        F.when(value > top, top)
        .when(value < bottom, bottom)
        .otherwise(cut.try_cast("decimal(18,8)"))
    )


def parse_decimal(text: Column, default: Column | None = None) -> Column:
    """Lenient number text to decimal(38,8); what does not parse becomes ``default`` (0).

    Accepts spaces, thousands commas, a sign on either end; no exponent. Digits beyond
    the eighth decimal are cut from the text, so nothing is rounded.
    """
    # A text that matches is rewritten as sign and digits; one that does not stays as it is.
    # Two signs give digits that do not cast.
    tidy = F.regexp_replace(text, _NUMBER, "=$1$4$2.$3")
    digits = F.when(tidy != text, F.replace(F.substring(tidy, 2, 2147483647), F.lit(","), F.lit("")))
    number = digits.try_cast("decimal(38,8)")
    lenient = F.when(F.abs(number) <= F.lit(MAX_DECIMAL).cast("decimal(38,8)"), number)
    return F.coalesce(
        F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("decimal(38,8)")).otherwise(lenient),
        F.lit(0).cast("decimal(38,8)") if default is None else default,
    )


def millis_to_ts(millis: Column) -> Column:
    """Epoch milliseconds to timestamp; a missing value is the epoch."""
    return F.timestamp_millis(F.coalesce(millis, F.lit(0).cast("bigint")))


def bucket_offset(interval_s: int) -> int:
    """Offset, in seconds, that makes epoch-based windows count from year 1."""
    return YEAR_ONE_SECONDS % interval_s


def bucket_window(ts: Column, interval_s: int) -> Column:
    """The tumbling window of a timestamp as Spark's ``window`` struct."""
    return F.window(
        ts, f"{interval_s} seconds", f"{interval_s} seconds", f"{bucket_offset(interval_s)} seconds"
    )


def bucket_start(ts: Column, interval_s: int) -> Column:
    """Start of the bucket as plain arithmetic, for use outside of aggregations."""
    step, shift = interval_s * 1_000_000, bucket_offset(interval_s) * 1_000_000
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(shift), F.lit(step)))


def interval_label(seconds: int | Column) -> Column:
    """Whole minutes as ``Nm``, everything else as ``Ns``: 60 -> 1m, 90 -> 90s, 3600 -> 60m."""
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    whole_minutes = (s >= 60) & (s % 60 == 0)
    return F.when(whole_minutes, F.concat((s / 60).cast("int").cast("string"), F.lit("m"))).otherwise(
        F.concat(s.cast("int").cast("string"), F.lit("s"))
    )


def uuid7(ts: Column) -> Column:
    """Time-ordered UUID: 48 bits of milliseconds, then random. Not deterministic."""
    rnd = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    ms = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    return F.concat_ws(
        "-",
        F.substring(ms, 1, 8),
        F.substring(ms, 9, 4),
        F.concat(F.lit("7"), F.substring(rnd, 14, 3)),
        F.substring(rnd, 17, 4),
        F.substring(rnd, 21, 12),
    )


def uuid4() -> Column:
    return F.uuid()


def stable_hash(text: Column) -> Column:
    """h = 17, then h * 31 + unit for each UTF-16 unit, in 32-bit wrap-around arithmetic, sign bit off."""

    def units(c: Column) -> Column:
        point = F.ascii(c).cast("bigint")
        high = F.lit(0xD800) + F.shiftright(point - 0x10000, 10)
        low = F.lit(0xDC00) + (point - 0x10000).bitwiseAND(F.lit(0x3FF).cast("bigint"))
        return F.when(point > 0xFFFF, F.array(high, low)).otherwise(F.array(point))

    codes = F.flatten(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), units))
    wrapped = F.aggregate(
        codes,
        F.lit(17).cast("bigint"),
        lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")),
    )
    return wrapped.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))


def shard(text: Column, n: int) -> Column:
    return (stable_hash(text) % n).cast("int")


def exchange_tag(exchange: Column, fallback: str = "raw", ignore_case: bool = False) -> Column:
    """Metric tag of an exchange. ``fallback`` is "raw" (keep the name) or a literal such as "unknown"."""
    name = F.lower(exchange) if ignore_case else exchange
    binance, kraken = ("binance", "kraken") if ignore_case else ("Binance", "Kraken")
    other = exchange if fallback == "raw" else F.lit(fallback)
    return F.when(name == binance, "binance").when(name == kraken, "kraken").otherwise(other)


def connection_message(exchange: Column, status: Column, message: Column) -> Column:
    """Log text of a status change; an error keeps its own message when it has one."""
    return (
        F.when(status == "Connected", F.concat(F.lit("Connected to "), exchange))
        .when(status == "Disconnected", F.concat(F.lit("Disconnected from "), exchange))
        .when(status == "Error", F.coalesce(message, F.concat(F.lit("Error on "), exchange)))
        .otherwise(F.concat(status, F.lit(" on "), exchange))
    )


def message_key(ticker: Column, exchange: Column) -> Column:
    return F.concat_ws(":", ticker, exchange)


def client_name(exchange: Column, symbol: Column) -> Column:
    return F.concat_ws("_", exchange, symbol)


def subscribe_message(symbol: Column) -> Column:
    """Text that subscribes to the trades of one symbol."""
    return F.format_string('{"method":"SUBSCRIBE","params":["%s@trade"],"id":1}', F.lower(symbol))


def partition_name(table: str, day: Column) -> Column:
    return F.concat(F.lit(table + "_"), F.date_format(day, "yyyy_MM_dd"))


def partition_day(table: str, name: Column) -> Column:
    """Date in a partition name; null when the suffix is not a valid date."""
    suffix = F.when(name.startswith(table + "_"), F.substring(name, len(table) + 2, 2147483647))
    strict = F.when(suffix.rlike(r"^\d{4}_\d{2}_\d{2}$"), suffix)
    return F.try_to_timestamp(strict, F.lit("yyyy_MM_dd")).cast("date")


def metric_value(text: Column) -> Column:
    """Sample text to double: NaN, infinities of either spelling, exponents; null when unreadable."""
    t = F.trim(text)
    return (
        F.when(t.isin("NaN", "nan"), F.lit(float("nan")))
        .when(t.isin("+Inf", "Inf", "inf"), F.lit(float("inf")))
        .when(t.isin("-Inf", "-inf"), F.lit(float("-inf")))
        .otherwise(t.try_cast("double"))
    )


def normalise_value_text(text: Column) -> Column:
    """The three special spellings; any other text is kept as it is."""
    t = F.trim(text)
    return (
        F.when(t.isin("NaN", "nan"), "NaN")
        .when(t.isin("+Inf", "Inf", "inf"), "Inf")
        .when(t.isin("-Inf", "-inf"), "-Inf")
        .otherwise(t)
    )


def _label_value(text: Column) -> Column:
    """The value behind its escapes: backslash, quote and line feed."""
    halves = F.split(text, r"\\\\", -1)
    plain = F.transform(halves, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')))
    return F.array_join(plain, "\\")


def label_map(labels: Column) -> Column:
    """Labels as a map; of a label that is given twice the last value counts."""
    p = F.lit(LABEL_PATTERN)
    names, values = (F.regexp_extract_all(labels, p, F.lit(i)) for i in (1, 2))
    places = F.when(F.size(names) > 0, F.sequence(F.lit(1), F.size(names))).otherwise(F.array().cast("array<int>"))
    last = F.filter(
        places, lambda i: F.array_position(F.slice(names, i + 1, F.size(names)), F.element_at(names, i)) == 0
    )
    return F.map_from_arrays(
        F.transform(last, lambda i: F.element_at(names, i)),
        F.transform(last, lambda i: _label_value(F.element_at(values, i))),
    )


def label_pairs(labels: Column) -> Column:
    """``k="v",...`` to ``k=v; ...``."""
    p = F.lit(LABEL_PATTERN)
    keys = F.regexp_extract_all(labels, p, F.lit(1))
    values = F.regexp_extract_all(labels, p, F.lit(2))
    return F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit("="), _label_value(v))), "; ")


def fill_percent(count: Column, capacity: Column) -> Column:
    """count / capacity in percent, one decimal; 0 when there is no capacity."""
    share = count.cast("double") / capacity.cast("double") * 100
    return F.round(F.when(capacity > 0, share).otherwise(F.lit(0.0)), 1)


def csv_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row, whatever is filtered on it later.

    A filter on a plain column is pushed below it together with a copy of its expression; a
    generated column stops that.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def required(*columns: str) -> Column:
    """True where every named column is present (the null guards of the entities)."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok
