"""Exchange messages to ticks. One column of JSON text in, typed rows out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.functions import millis_to_ts, parse_decimal, truncate_price, with_once
from ticklake.schemas import KRAKEN_MESSAGE, TRADE_FIELDS, TRADE_MESSAGE

MAX_MESSAGE_BYTES = 1 << 20

# status of a parsed message
TICK, IGNORED, DEAD = "tick", "ignored", "dead"


@dataclass(frozen=True)
class Parser:
    """How one exchange's text becomes a tick. Both steps are expressions, never Python per row.

    ``read`` turns the text into a struct. ``fields`` picks from that struct: ``trade`` (is it
    one), ``trade_id``, ``ticker``, ``price`` and ``volume`` still as text, ``ts``, and
    ``unread`` (nothing was found, so the text may not be JSON). Two steps, so that the text
    is read once however many fields look at it. A message with several trades names their array
    as ``entries``; ``fields`` then gets the message and one entry, and each entry is a row.
    """

    read: Callable[[Column], Column]
    fields: Callable[..., dict[str, Column]]
    entries: Callable[[Column], Column] | None = None


def _object(text: Column) -> Column:
    """The text if it is a JSON object; an array around one is no message."""
    return F.when(text.rlike(r"^\s*\{"), text)


def _binance_fields(m: Column) -> dict[str, Column]:
    return {
        "unread": m["event"].isNull(),
        "trade": m["event"] == "trade",
        "trade_id": m["trade_id"],
        "ticker": m["symbol"],
        "price": m["price"],
        "volume": m["quantity"],
        "ts": F.timestamp_millis(m["trade_ms"]),
    }


def _kraken_fields(m: Column, entry: Column) -> dict[str, Column]:
    return {
        "unread": m["channel"].isNull(),
        "trade": (m["channel"] == "trade") & entry.isNotNull(),
        "trade_id": entry["trade_id"].try_cast("bigint"),
        "ticker": entry["symbol"],
        "price": entry["price"],
        "volume": entry["qty"],
        "ts": F.try_to_timestamp(entry["timestamp"]),
    }


# Arrival numbers that one message with several trades takes: entry i of message n arrives as
# n * ENTRY_SPAN + i. A message of the largest size holds fewer entries.
ENTRY_SPAN = 1 << 20

# Trades of the first exchange, and of the second (every entry of ``data``). Anything but a
# trade with a symbol is ignored; text that is not JSON is dead.
PARSERS: dict[str, Parser] = {
    "binance": Parser(lambda v: F.from_json(_object(v), TRADE_MESSAGE).cast(TRADE_FIELDS), _binance_fields),
    "kraken": Parser(lambda v: F.from_json(_object(v), KRAKEN_MESSAGE), _kraken_fields, lambda m: m["data"]),
}


def register_parser(exchange: str, parser: Parser) -> None:
    PARSERS[exchange.lower()] = parser


def parse(
    messages: DataFrame,
    exchange: str,
    value: str = "value",
    max_bytes: int = MAX_MESSAGE_BYTES,
    strict: bool = False,
    first_only: bool = False,
) -> DataFrame:
    """Every message with its parse result in ``m``; longer ones than ``max_bytes`` are dead.

    A message with several trades gives a row for each, numbered in ``m.entry`` (null for messages
    that hold one trade by their form); ``first_only`` takes just the first.

    A price or volume that does not parse is 0 and a missing time is the epoch; ``strict``
    sends such ticks to the dead letters instead.
    """
    parser, text = PARSERS[exchange.lower()], F.col(value)
    big = F.octet_length(text) > max_bytes
    # An oversized text is never read.
    raw = with_once(messages, "_raw", parser.read(F.when(~big, text)))
    if parser.entries is None:
        raw = raw.withColumn("_entry_no", F.lit(None).cast("bigint"))
        fields = parser.fields(F.col("_raw"))
    else:
        entries = parser.entries(F.col("_raw"))
        entries = F.slice(entries, 1, 1) if first_only else entries
        raw = raw.select("*", F.posexplode_outer(entries).alias("_no", "_entry"))
        raw = raw.withColumn("_entry_no", F.coalesce("_no", F.lit(0)).cast("bigint"))
        fields = parser.fields(F.col("_raw"), F.col("_entry"))
    # Only a text in which nothing was found is checked for being JSON at all.
    malformed = F.when(~big & fields["unread"], F.try_parse_json(text).isNull())
    missing = F.lit(None).cast("decimal(38,8)")
    numbers = F.struct(*[parse_decimal(fields[n], missing).alias(n) for n in ("price", "volume")])
    picked = with_once(raw, "_n", numbers).select(
        *messages.columns,
        "_entry_no",
        big.alias("_big"),
        F.coalesce(malformed, F.lit(False)).alias("_malformed"),
        F.coalesce(fields["trade"], F.lit(False)).alias("_trade"),
        *[fields[n].alias(f"_{n}") for n in ("trade_id", "ticker", "ts")],
        F.col("_n.price").alias("_price"),
        F.col("_n.volume").alias("_volume"),
    )
    c = {n: F.col(f"_{n}") for n in ("big", "malformed", "trade", "trade_id", "ticker", "price", "volume", "ts")}
    partial = c["price"].isNull() | c["volume"].isNull() | c["ts"].isNull()
    partial = F.lit(strict) & c["trade"] & c["ticker"].isNotNull() & partial
    zero = F.lit(0).cast("decimal(18,8)")
    return picked.select(
        *messages.columns,
        F.lit(exchange).alias("exchange"),
        F.struct(
            F.when(c["big"] | c["malformed"] | partial, DEAD)
            .when(c["trade"] & c["ticker"].isNotNull(), TICK)
            .otherwise(IGNORED)
            .alias("status"),
            F.when(c["big"], "oversized")
            .when(c["malformed"], "malformed")
            .when(~c["trade"], "not_a_trade")
            .when(c["ticker"].isNull(), "no_symbol")
            .when(partial, "incomplete")
            .alias("reason"),
            F.col("_entry_no").alias("entry"),
            c["trade_id"].alias("trade_id"),
            c["ticker"].alias("ticker"),
            F.coalesce(truncate_price(c["price"]), zero).alias("price"),
            F.coalesce(truncate_price(c["volume"]), zero).alias("volume"),
            F.coalesce(c["ts"], millis_to_ts(F.lit(None).cast("bigint"))).alias("ts"),
        ).alias("m"),
    )


def ticks(parsed: DataFrame, seq: str | None = None) -> DataFrame:
    """The good rows as ticks. ``seq`` names the arrival number; without it the trade id serves.

    Trades of one message follow each other in arrival (``ENTRY_SPAN``).
    """
    several = F.col("m.entry").isNotNull()
    arrival = F.when(several, F.col(seq) * ENTRY_SPAN + F.col("m.entry")).otherwise(F.col(seq)) if seq else None
    number = F.col("m.trade_id") if seq is None else arrival
    return parsed.where(F.col("m.status") == TICK).select(
        number.alias("trade_id"), "m.ticker", "exchange", "m.price", "m.volume", "m.ts"
    )


def dead_letters(parsed: DataFrame, value: str = "value") -> DataFrame:
    keep = [c for c in parsed.columns if c not in ("m", "exchange", value)]
    return parsed.where(F.col("m.status") == DEAD).select(
        *keep, "exchange", F.col("m.reason").alias("reason"), F.col(value).alias("value")
    )


def without_keepalive(messages: DataFrame, word: str = "heartbeat", value: str = "value") -> DataFrame:
    """Leave out heartbeats / pings by plain text search, before anything is parsed."""
    return messages.where(~F.contains(F.col(value), F.lit(word)))


def kraken_fields(messages: DataFrame, value: str = "value", every: bool = False) -> DataFrame:
    """The six fields as text, 'N/A' when absent: of the first entry of each trade message, or of
    every entry."""
    m = F.from_json(F.col(value), KRAKEN_MESSAGE)
    keep = [c for c in messages.columns if c != value]
    trades = with_once(messages, "_m", m).where(
        (F.col("_m.channel") == "trade") & (F.size("_m.data") > 0)
    )
    entry = F.explode("_m.data") if every else F.element_at("_m.data", 1)
    return trades.select(*keep, entry.alias("d")).select(
        *keep,
        *[
            F.coalesce(F.col(f"d.{c}"), F.lit("N/A")).alias(c)
            for c in ("symbol", "price", "qty", "side", "trade_id", "timestamp")
        ],
    )


def json_field(value: Column, key: str) -> Column:
    """One top-level field of a JSON text as text, 'N/A' when absent."""
    return F.coalesce(F.get_json_object(value, f"$.{key}"), F.lit("N/A"))


def trade_fields(messages: DataFrame, value: str = "value") -> DataFrame:
    """Field-by-field view of trade messages, with the side that started the trade."""
    keep = [c for c in messages.columns if c != value]
    # All five in one pass over the text.
    one_pass = F.json_tuple(F.col(value), "s", "p", "q", "T", "m").alias("_s", "_p", "_q", "_t", "_m")
    names = {"_s": "symbol", "_p": "price", "_q": "quantity", "_t": "trade_ms"}
    return messages.select(*keep, one_pass).select(
        *keep,
        *[F.coalesce(F.col(c), F.lit("N/A")).alias(n) for c, n in names.items()],
        F.when(F.col("_m") == "true", "seller").otherwise("buyer").alias("initiator"),
    )
