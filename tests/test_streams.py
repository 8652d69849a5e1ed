from datetime import timedelta

import pytest
from base import BASE
from pyspark.sql import functions as F
from test_dedup import stream as random_ticks
from test_sources import trade

from ticklake.operators import candles, dedup, fifo
from ticklake.files import order_by_name
from ticklake.plans import q_streaming
from ticklake.sources.tables import read_ticks
from ticklake.streaming import candles as sc
from ticklake.streaming import dedup as sd
from ticklake.streaming.ingest import Ingest, message_stream


def tick_files(spark, ticks, path, files=4):
    ticks.repartitionByRange(files, "trade_id").sortWithinPartitions("trade_id").write.mode("append").parquet(path)
    order_by_name(spark, path)
    return spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, spark, folder):
    out = folder("out")
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", folder("cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@pytest.mark.parametrize("size,shards", [(4, 1), (9, 3)])
def test_fifo_stream_equals_batch(spark, make_ticks, folder, size, shards):
    ticks = make_ticks(random_ticks(500, 8, 11))
    out = run(sd.fifo(tick_files(spark, ticks, folder()), size, shards, "ticker"), spark, folder)
    batch = fifo.fifo_dedup(ticks, size, shards, "ticker")
    assert sorted(r.trade_id for r in out.collect()) == sorted(r.trade_id for r in batch.collect())


def test_dedup_within_watermark(spark, make_ticks, folder):
    ticks = make_ticks(random_ticks(300, 5, 2))
    out = run(sd.within_watermark(tick_files(spark, ticks, folder()), "1 day"), spark, folder)
    key = ["ticker", "exchange", "ts"]
    assert out.count() == ticks.select(*key).distinct().count()
    assert out.select(*key).exceptAll(dedup.distinct_keys(ticks)).isEmpty()


def test_late_ticks_add_a_row_and_merge(spark, make_ticks, folder):
    src, path, cp = folder(), folder(), folder()
    rows = [("X", 10 + i, 1, i * 20, "B") for i in range(9)]
    first = make_ticks(rows)
    sc.write_partials(tick_files(spark, first, src, 1), 60, path, cp).awaitTermination()
    assert sc.late_rows(spark, path).isEmpty()
    late = make_ticks([("X", 99, 5, 1, "B")]).selectExpr(
        "trade_id + 100 as trade_id", "ticker", "exchange", "price", "volume", "ts"
    )
    late.write.mode("append").parquet(src)
    stream = spark.readStream.schema(first.schema).parquet(src)
    sc.write_partials(stream, 60, path, cp).awaitTermination()
    (twice,) = sc.late_rows(spark, path).collect()
    assert twice.start_time == BASE and twice.rows == 2
    expected = candles.ohlcv(first.unionByName(late), 60)
    merged = sc.read_merged(spark, path)
    assert expected.exceptAll(merged).isEmpty() and merged.exceptAll(expected).isEmpty()


def test_closed_and_open_candles(spark, make_ticks, folder):
    ticks = make_ticks([("X", 1 + i, 1, 60 * i, "B") for i in range(8)])
    out = run(sc.closed_candles(tick_files(spark, ticks, folder()), 60, "2 minutes"), spark, folder)
    closed = {r.start_time for r in out.collect()}
    assert closed == {BASE + timedelta(minutes=i) for i in range(5)}
    rest = {r.start_time for r in sc.open_candles(ticks, out, 60).collect()}
    assert rest == {BASE + timedelta(minutes=i) for i in (5, 6, 7)}


@pytest.fixture
def wire(spark, folder):
    def build(values):
        path = folder("wire")
        df = spark.createDataFrame(list(enumerate(values)), "seq bigint, value string")
        df.repartitionByRange(2, "seq").write.parquet(path)
        order_by_name(spark, path)
        return path

    return build


MINUTE = 1704103200000


def messages():
    good = [trade(T=MINUTE + i * 10_000, p=str(100 + i), t=i) for i in range(12)]
    return good + ["broken", trade(e="other")] + good[:6]


def test_ingest_fans_out(spark, wire, folder):
    job = Ingest("Binance", folder("ingest"), 60)
    src, cp = wire(messages()), folder("cp")
    job.start(message_stream(spark, src, files_per_trigger=1), cp).awaitTermination()
    table = read_ticks(spark, job.tick_path)
    assert table.count() == 12
    assert [r.value for r in spark.read.parquet(job.dead_path).collect()] == ["broken"]
    merged = sc.read_merged(spark, job.candle_path)
    assert sorted((r.ticks, int(r.open), int(r.close)) for r in merged.collect()) == [(6, 100, 105), (6, 106, 111)]
    day = BASE.date()
    assert sc.read_merged(spark, job.candle_path, day, day).count() == 2
    assert sc.read_merged(spark, job.candle_path, day + timedelta(days=1)).isEmpty()
    # Same checkpoint again: nothing new.
    job.start(message_stream(spark, src), cp).awaitTermination()
    assert read_ticks(spark, job.tick_path).count() == 12


def test_raw_candles_count_copies(spark, wire, folder):
    job = Ingest("Binance", folder("ingest"), 60, candles_from="raw")
    job.start(message_stream(spark, wire(messages())), folder("cp")).awaitTermination()
    assert sorted(r.ticks for r in sc.read_merged(spark, job.candle_path).collect()) == [6, 12]
    with pytest.raises(ValueError):
        Ingest("Binance", folder("x"), candles_from="other")


@pytest.mark.parametrize("written", [0, 5, 12])
def test_replay_after_a_failure_half_way(spark, folder, written):
    """The batch died after staging, with some of its rows already in the table."""
    job = Ingest("Binance", folder("ingest"), 60)
    rows = spark.createDataFrame(list(enumerate(messages())), "seq bigint, value string")

    class Crash(Exception):
        pass

    def crash(df, n, stream):
        raise Crash

    failing = Ingest("Binance", job.base, 60, candle_sink=crash)
    with pytest.raises(Crash):
        failing.batch(rows, 0)
    # Keep only some of the rows the failed batch wrote.
    from ticklake.sinks.ticks import delete_rows

    gone = read_ticks(spark, job.tick_path).orderBy("trade_id").select("ticker", "exchange", "ts").collect()[written:]
    if gone:
        delete_rows(spark, job.tick_path, spark.createDataFrame(gone, "ticker string, exchange string, ts timestamp"))
    job.batch(rows, 0)
    job.batch(rows, 0)
    assert read_ticks(spark, job.tick_path).count() == 12
    assert sorted(r.ticks for r in sc.read_merged(spark, job.candle_path).collect()) == [6, 6]


def test_batches_run_with_adaptive_execution(spark, wire, folder):
    seen = []

    def sink(df, n, stream):
        seen.append((df.sparkSession.conf.get("spark.sql.adaptive.enabled"), df.count()))

    job = Ingest("Binance", folder("ingest"), 60, candle_sink=sink)
    job.start(message_stream(spark, wire(messages())), folder("cp")).awaitTermination()
    assert seen == [("true", 2)]
    # Staging of committed work does not pile up.
    from ticklake import files

    for folder_ in files.partition_folders(spark, job.staging, "stream").values():
        assert not files.exists(spark, f"{folder_}/incoming")


def test_first_arrivals_lose_nothing_that_is_late(spark, make_ticks, folder):
    ticks = make_ticks([("X", 1, 1, 50_000, "B"), ("X", 2, 1, 50_000, "B"), ("X", 3, 1, 5, "B"), ("X", 4, 1, 5, "B")])
    src, path, cp = folder(), folder(), folder()
    for _ in range(2):  # the second run finds nothing new
        stream = tick_files(spark, ticks, src) if not _ else spark.readStream.schema(ticks.schema).parquet(src)
        sd.first_arrivals(stream, path, cp).awaitTermination()
    out = sd.read_first_arrivals(spark, path, ticks.schema)
    assert sorted((r.trade_id, int(r.price)) for r in out.collect()) == [(0, 1), (2, 3)]
    # a new stream over the same files adds nothing either
    sd.first_arrivals(spark.readStream.schema(ticks.schema).parquet(src), path, folder()).awaitTermination()
    assert sd.read_first_arrivals(spark, path, ticks.schema).count() == 2


def test_second_feed_and_new_checkpoint(spark, wire, folder):
    base = folder("ingest")
    first = [trade(T=MINUTE + i * 10_000, t=i, s="BTC") for i in range(4)] + ["bad one"]
    second = [trade(T=MINUTE + i * 10_000, t=i, s="ETH") for i in range(4)] + ["bad two"]
    for values in (first, second, second):
        job = Ingest("Binance", base, 60)
        job.start(message_stream(spark, wire(values)), folder("cp")).awaitTermination()
    assert sorted(r.ticker for r in read_ticks(spark, job.tick_path).collect()) == ["BTC"] * 4 + ["ETH"] * 4
    assert {(r.ticker, r.ticks) for r in sc.read_merged(spark, job.candle_path).collect()} == {("BTC", 4), ("ETH", 4)}
    dead = spark.read.parquet(job.dead_path)
    assert sorted(r.value for r in dead.collect()) == ["bad one", "bad two", "bad two"]
    assert dead.select("stream").distinct().count() == 3


def test_open_candles_after_the_watermark(make_ticks):
    ticks = make_ticks([("X", 1 + i, 1, 60 * i, "B") for i in range(8)])
    closed = candles.ohlcv(ticks, 60).where("false")
    rest = sc.open_candles(ticks, closed, 60, BASE + timedelta(minutes=5, seconds=30))
    assert {r.start_time for r in rest.collect()} == {BASE + timedelta(minutes=i) for i in (5, 6, 7)}


def test_a_large_batch_of_messages_is_several_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q_streaming, "FILE_ROWS", 10)
    messages = spark.range(240).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("value"))
    got = []

    def sink(batch, n):
        got.append((sorted(r.seq for r in batch.collect()), batch.select(F.input_file_name()).distinct().count()))

    stream = q_streaming.message_batches(spark, messages, "several-files", 4).writeStream.foreachBatch(sink)
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 4 and all(files > 1 for _, files in got)
    assert [seq for rows, _ in got for seq in rows] == list(range(240))
