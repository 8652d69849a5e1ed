"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
The published figures to compare with are ticks per second of a whole ingest pipeline, so the
line also carries ``ticks_per_sec`` for the steps that move ticks.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ticklake.operators import candles, reads  # noqa: E402
from ticklake.plans import load  # noqa: E402
from ticklake.plans import views as v  # noqa: E402
from ticklake.plans.q_aggregates import line_ticks  # noqa: E402
from ticklake.session import clean_scratch, configure, local_session, scratch  # noqa: E402
from ticklake.sinks import versioned  # noqa: E402
from ticklake.sinks.ticks import insert_ignore  # noqa: E402
from ticklake.sources import messages  # noqa: E402
from ticklake.sources.tables import read_ticks  # noqa: E402
from ticklake.streaming.ingest import Ingest, message_stream  # noqa: E402

QUERIES = [
    "agg01_ohlcv_1h",
    "agg01_ohlcv_1m",
    "agg02_coarsen",
    "win01_first_arrival",
    "win02_sliding_rate_60s",
    "win04_progress_marks_orders",
    "win06_active_connections",
    "join01_missing_keys",
    "join04_help_and_type",
    "agg12_histogram",
    "met02_counter_rate",
    "met04_for_duration",
    "met08_balance",
    "src04_field_extract",
    "str06_fifo_batch",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, repeat: int = 2) -> float:
    best = None
    for _ in range(repeat):
        start = time.perf_counter()
        action()
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(local_session(cpus, "ticklake-bench"))
    registered, _ = load()
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}

    # Inputs that are not part of any timing: wire messages and ticks as files.
    wire, flat = scratch(spark, "wire"), scratch(spark, "flat")
    v.messages(spark, sf_dir).repartitionByRange(int(cpus), "seq").write.parquet(wire)
    v.ticks(spark, sf_dir).write.parquet(flat)
    received = spark.read.schema("seq BIGINT, value STRING").parquet(wire)
    n_messages = received.count()

    def parsed():
        return messages.ticks(messages.parse(received, "Binance"), "seq")

    seconds["parse_messages"] = timed(lambda: run(parsed()), 3)
    rates["parse_messages"] = round(n_messages / seconds["parse_messages"])

    # parse -> first arrival -> insert-if-absent into a day-partitioned table
    seconds["ingest_new"] = timed(lambda: insert_ignore(spark, parsed(), scratch(spark, "ingest")))
    rates["ingest_new"] = round(n_messages / seconds["ingest_new"])

    full = scratch(spark, "full")
    insert_ignore(spark, parsed(), full)
    seconds["ingest_redelivered"] = timed(lambda: insert_ignore(spark, parsed(), full))
    rates["ingest_redelivered"] = round(n_messages / seconds["ingest_redelivered"])

    # The published runs take in 1.7 million ticks of which 3 % are copies. Here every event
    # becomes 17 ticks a millisecond apart; each tick of a 33rd part arrives again at the end.
    load_path = scratch(spark, "load")
    copies = F.explode(F.sequence(F.lit(0), F.lit(16))).alias("i")
    many = v.ticks(spark, sf_dir).select("*", copies)
    many = many.withColumn("ts", F.timestamp_millis(F.unix_millis("ts") + F.col("i")))
    many = many.withColumn("trade_id", F.col("trade_id") * 17 + F.col("i")).drop("i")
    again = many.where(F.pmod(F.xxhash64("trade_id"), F.lit(33)) == 0)
    again = again.withColumn("trade_id", F.col("trade_id") + 1_000_000_000)
    body = F.to_json(
        F.struct(
            F.lit("trade").alias("e"),
            F.unix_millis("ts").alias("E"),
            F.col("ticker").alias("s"),
            F.col("trade_id").alias("t"),
            F.col("price").cast("string").alias("p"),
            F.col("volume").cast("string").alias("q"),
            F.unix_millis("ts").alias("T"),
        )
    )
    whole = many.unionByName(again).select(F.col("trade_id").alias("seq"), body.alias("value"))
    whole.repartitionByRange(int(cpus), "seq").write.parquet(load_path)
    loaded = spark.read.schema("seq BIGINT, value STRING").parquet(load_path)
    n_loaded = loaded.count()

    def published():
        insert_ignore(spark, messages.ticks(messages.parse(loaded, "Binance"), "seq"), scratch(spark, "published"))

    seconds["ingest_published_load"] = timed(published)
    rates["ingest_published_load"] = round(n_loaded / seconds["ingest_published_load"])

    def stream():
        job = Ingest("Binance", scratch(spark, "stream"), 60)
        job.start(message_stream(spark, load_path), scratch(spark, "stream-cp")).awaitTermination()

    seconds["ingest_stream"] = timed(stream, 1)
    rates["ingest_stream"] = round(n_loaded / seconds["ingest_stream"])

    # The same load again, a file per micro-batch, against a table that holds all of it; the table has versions.
    def stream_redelivered():
        base = scratch(spark, "stream-full")
        versioned.insert_new(spark, messages.ticks(messages.parse(loaded, "Binance"), "seq"), f"{base}/ticks")
        start = time.perf_counter()
        source = message_stream(spark, load_path, files_per_trigger=1)
        job = Ingest("Binance", base, 60, keep_versions=True)
        job.start(source, scratch(spark, "stream-full-cp")).awaitTermination()
        return round(time.perf_counter() - start, 3)

    seconds["ingest_stream_batches"] = stream_redelivered()
    rates["ingest_stream_batches"] = round(n_loaded / seconds["ingest_stream_batches"])

    lines = line_ticks(spark, sf_dir)
    n_lines = lines.count()
    seconds["candles_lineitem_1d"] = timed(lambda: run(candles.ohlcv(lines, 86400)))
    rates["candles_lineitem_1d"] = round(n_lines / seconds["candles_lineitem_1d"])

    # the five reads, on the partitioned table
    table_path = scratch(spark, "table")
    insert_ignore(spark, v.ticks(spark, sf_dir), table_path)
    table = read_ticks(spark, table_path)
    five = {
        "rq_full_scan": lambda: run(reads.find(table, "ticker = 'CLICK'")),
        "rq_range_1d": lambda: run(reads.ticker_range(table, "CLICK", *v.DAY)),
        "rq_range_1h": lambda: run(reads.ticker_range(table, "CLICK", *v.HOUR)),
        "rq_count_range": lambda: run(reads.count_range(table, "CLICK", *v.DAY)),
        "rq_topn_1000": lambda: run(reads.newest(table, "CLICK", 1000)),
    }
    for name, action in five.items():
        seconds[name] = timed(action, 3)

    for name in QUERIES:
        seconds[name] = timed(lambda: run(registered[name](spark, sf_dir)))

    clean_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "ticklake_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "ticks_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
