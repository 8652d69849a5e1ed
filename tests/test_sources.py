import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ticklake.operators import reads
from ticklake.sources import messages as m
from ticklake.sources import metrics_text as mt
from ticklake.sources import tables


def text(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq bigint, value string")


def trade(**fields):
    base = {"e": "trade", "E": 1, "s": "BTCUSDT", "t": 7, "p": "1000.50", "q": "0.5", "T": 1609459200000, "m": True, "M": True}
    base.update(fields)
    return json.dumps({k: v for k, v in base.items() if v is not None})


def test_trades(spark):
    parsed = m.parse(
        text(
            spark,
            trade(),
            trade(s="ETHUSDT", p="2500.75", q="1.25"),
            trade(e="24hrTicker"),
            trade(s=None),
            "not valid json",
            trade(p=None, q=None),
            trade(T=None),
            trade(p=12.5),
            "[1, 2]",
            '"text"',
        ),
        "Binance",
    )
    good = {r.trade_id: r for r in m.ticks(parsed, "seq").collect()}
    assert sorted(good) == [0, 1, 5, 6, 7]
    assert (good[0].ticker, good[0].price, good[0].volume) == ("BTCUSDT", Decimal("1000.5"), Decimal("0.5"))
    assert good[0].ts == datetime(2021, 1, 1) and good[0].exchange == "Binance"
    assert (good[1].price, good[1].volume) == (Decimal("2500.75"), Decimal("1.25"))
    assert (good[5].price, good[5].volume) == (0, 0)
    assert good[6].ts == datetime(1970, 1, 1)
    assert good[7].price == Decimal("12.5")
    dead = {r.seq: r.reason for r in m.dead_letters(parsed).collect()}
    assert dead == {4: "malformed"}
    assert m.ticks(parsed).where("trade_id = 7").count() == 5


def test_only_whole_objects_are_messages(spark):
    whole = trade()
    rows = text(spark, "[" + whole + "]", whole[:-1], whole[:40], " \n" + whole, "", None)
    parsed = m.parse(rows, "Binance")
    assert [r.trade_id for r in m.ticks(parsed, "seq").collect()] == [3]
    status = {r.seq: r.status for r in parsed.select("seq", "m.status").collect()}
    assert status[0] == "ignored" and status[1] == status[2] == "dead"


def test_strict_and_oversized(spark):
    rows = text(spark, trade(), trade(p=None), trade(q="x"), trade(T=None), trade(e="ping", p=None))
    strict = {r.seq: r.reason for r in m.dead_letters(m.parse(rows, "binance", strict=True)).collect()}
    assert strict == {1: "incomplete", 2: "incomplete", 3: "incomplete"}
    big = m.dead_letters(m.parse(text(spark, trade(), trade(x="y" * 500)), "binance", max_bytes=300))
    assert [(r.seq, r.reason) for r in big.collect()] == [(1, "oversized")]


def kraken(channel="trade", data=None):
    return json.dumps({"channel": channel, "data": data} if data is not None else {"channel": channel})


def test_second_exchange(spark):
    entry = {"symbol": "BTC/USD", "price": 50000.10, "qty": 0.25, "side": "buy", "trade_id": 42,
             "timestamp": "2024-01-02T03:04:05.678901Z"}
    other = {"symbol": "ETH/USD", "price": 3000}
    rows = text(spark, kraken(data=[entry, other]), kraken(data=[]), kraken("heartbeat"), "{", kraken(data=[{"price": 1}]))
    good = m.ticks(m.parse(rows, "Kraken")).collect()
    assert [(r.trade_id, r.ticker, int(r.price)) for r in good] == [(42, "BTC/USD", 50000), (None, "ETH/USD", 3000)]
    assert good[0].price == Decimal("50000.1")
    assert good[0].ts == datetime(2024, 1, 2, 3, 4, 5, 678901)
    numbered = m.ticks(m.parse(rows, "Kraken"), "seq").collect()
    assert [r.trade_id for r in numbered] == [0, 1]  # message 0, entries 0 and 1
    assert m.ticks(m.parse(rows, "Kraken", first_only=True)).count() == 1
    assert [r.seq for r in m.dead_letters(m.parse(rows, "Kraken")).collect()] == [3]
    first = m.kraken_fields(rows).orderBy("seq").collect()
    assert [(r.symbol, r.side, r.trade_id) for r in first] == [("BTC/USD", "buy", "42"), ("N/A", "N/A", "N/A")]
    assert m.kraken_fields(rows, every=True).count() == 3
    assert [r.seq for r in m.without_keepalive(rows).orderBy("seq").collect()] == [0, 1, 3, 4]


def test_field_view(spark):
    r = m.trade_fields(text(spark, trade(), "{}", "oops")).orderBy("seq").collect()
    assert (r[0].symbol, r[0].price, r[0].trade_ms, r[0].initiator) == ("BTCUSDT", "1000.50", "1609459200000", "seller")
    assert (r[1].symbol, r[1].initiator) == ("N/A", "buyer") and r[2].price == "N/A"
    v = F.col("value")
    one = text(spark, trade()).select(m.json_field(v, "s").alias("s"), m.json_field(v, "zz").alias("z")).first()
    assert tuple(one) == ("BTCUSDT", "N/A")


SCRAPE = """# HELP ticks_incoming_count_total Total ticks entering the processor pipeline
# TYPE ticks_incoming_count_total counter
ticks_incoming_count_total{exchange="binance"} 83028
processor_channel_backlog_count 33028
bad line here
some_gauge NaN
# HELP write_ms Time to write
# TYPE write_ms histogram
write_ms_bucket{le="+Inf"} 5
write_ms_sum 1.5e2
up +Inf
  # remark

late{a="b"} 1 1700000000
"""


def test_metric_text(spark, folder):
    path = folder("scrape")
    spark.createDataFrame([(SCRAPE,)], "value string").coalesce(1).write.text(path)
    lines = mt.read_scrapes(spark, path)
    rows = {r.metric: r for r in mt.samples(lines).collect()}
    assert set(rows) == {
        "ticks_incoming_count_total", "processor_channel_backlog_count", "some_gauge", "write_ms_bucket",
        "write_ms_sum", "up", "late",
    }
    assert rows["late"].value == "1"  # the time after the value is not part of it
    first = rows["ticks_incoming_count_total"]
    assert (first.labels, first.type, first.value) == ('exchange="binance"', "counter", "83028")
    assert first.description == "Total ticks entering the processor pipeline"
    assert rows["processor_channel_backlog_count"].type == "" and rows["some_gauge"].value == "NaN"
    assert rows["write_ms_bucket"].type == "histogram" and rows["up"].value == "Inf"
    strict = {r.metric: r.type for r in mt.samples(lines, strict_name=True).collect()}
    assert strict["write_ms_bucket"] == "" and strict["ticks_incoming_count_total"] == "counter"
    typed = {r.metric: r for r in mt.typed(mt.samples(lines)).collect()}
    assert typed["write_ms_bucket"].labels == {"le": "+Inf"} and typed["write_ms_sum"].value == 150.0
    dead = [r.line for r in mt.parse_lines(lines).where("kind = 'dead'").collect()]
    assert dead == ["bad line here"]
    assert reads.first_by_prefix(lines, "processor_").first().line == "processor_channel_backlog_count 33028"


def test_csv_round_trip(spark, folder):
    row = ("2024-01-01", "m", 'exchange="binance"', "counter", "1", 'says "hi", twice\nand more')
    path = folder("csv")
    from ticklake.schemas import METRIC_CSV

    mt.write_csv(spark.createDataFrame([row], METRIC_CSV), path)
    assert tuple(mt.read_csv(spark, path).first()) == row
    raw = spark.read.text(path).collect()
    assert raw[0].value == '"Timestamp","Metric","Labels","Type","Value","Description"' or raw[0].value.startswith("Timestamp")
    assert any('"exchange=""binance"""' in r.value for r in raw)


def test_run_json_array(spark, folder):
    path = folder("runs")
    body = json.dumps([{"method": "a", "mode": "Sequential", "chunk_size": 1000, "total_ticks": 5}])
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)
    r = tables.read_runs_array(spark, path).first()
    assert (r.method, r.chunk_size, r.total_ticks, r.elapsed_ms) == ("a", 1000, 5, None)


@pytest.mark.parametrize("name", ["binance", "KRAKEN"])
def test_registry_ignores_case(spark, name):
    assert m.parse(text(spark, "{}"), name).count() == 1



@pytest.fixture
def small_splits(spark):
    """Files are read in splits of 2 kB, as large ones are in splits of many MB."""
    keys = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, value in keys.items():
        spark.conf.set(k, value)
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


def test_a_large_scrape_is_read_by_many_tasks(spark, tmp_path, small_splits):
    lines = []
    for i in range(2000):
        if i % 50 == 0:
            lines += [f"# HELP m{i // 50} about {i}", f"# TYPE m{i // 50} gauge", ""]
        lines.append(f'm{i // 50}{{id="{i}"}} {i}.5')
    (tmp_path / "one.prom").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "two.prom").write_text("m0 1\n# HELP m0 other\n")
    read = mt.read_scrapes(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 10 or read.select(F.spark_partition_id()).distinct().count() > 4
    got = {}
    for r in read.collect():
        got.setdefault(r.scrape.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    assert [x for _, x in sorted(got["one.prom"])] == lines and len({n for n, _ in got["one.prom"]}) == len(lines)
    found = mt.samples(read).where("metric = 'm0'").collect()
    assert {(r.scrape[-8:], r.description, r.type) for r in found} == {("one.prom", "about 0", "gauge"), ("two.prom", "other", "")}
    # a directive reaches the samples of the splits behind it
    assert {r.description for r in mt.samples(read).where("metric = 'm39'").collect()} == {"about 1950"}


def test_a_large_quoted_csv_is_read_by_many_tasks(spark, tmp_path, small_splits):
    import csv

    rows = [(f"t{i}", f"m{i}", 'a="x, y"\nb="z"' if i % 3 == 0 else "", "gauge", str(i), "\n\n" * (i % 5) + f'say "{i}"') for i in range(600)]
    for name, part in (("one.csv", rows[:590]), ("two.csv", rows[590:]), ("none.csv", [])):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
            out.writerow(["Timestamp", "Metric", "Labels", "Type", "Value", "Description"])
            out.writerows(part)
    got = mt.read_csv(spark, str(tmp_path))
    want = spark.read.schema(got.schema).csv(str(tmp_path), header=True, quote='"', escape='"', multiLine=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 600
