"""Streams with keyed state against their batch twins, in any split of the batches."""

from datetime import timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from base import BASE
from pyspark.sql import functions as F


from ticklake.operators import fifo, metrics, rates
from ticklake.streaming import alerts, dedup, live

SAMPLE = "metric string, exchange string, ts timestamp, value decimal(20,2), labels string"


def batched(spark, df, path, cuts, order):
    """The rows of a frame as files that a stream reads one by one, cut at these places of their order."""
    rows = df.orderBy(order).collect()
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], df.schema).coalesce(1).write.mode("append").parquet(path)
        # one file a batch, in order
    order_by_name_by_time(spark, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def order_by_name_by_time(spark, path):
    """Files keep the order they were written in."""
    from ticklake.files import _path

    fs, p = _path(spark, path)
    found = sorted((s for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")), key=lambda s: s.getModificationTime())
    for i, status in enumerate(found):
        fs.setTimes(status.getPath(), 1_700_000_000_000 + i * 1000, -1)


def run(stream, spark, folder, mode="update"):
    out, cp = folder("out"), folder("cp")

    def sink(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


CUTS = [[], [1, 2, 60], [50], [37, 38, 90, 120]]


def client_ticks(spark, n=150, seed=1):
    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.choice([0, 200, 900, 5000, 90_000], n, p=[0.3, 0.3, 0.2, 0.15, 0.05]))
    rows = [(i, "AB"[int(rng.integers(2))], BASE + timedelta(milliseconds=int(t))) for i, t in enumerate(at)]
    return spark.createDataFrame(rows, "trade_id long, exchange string, ts timestamp")


@pytest.mark.parametrize("cuts", CUTS[:3])
def test_streamed_rates_equal_the_batch(spark, folder, cuts):
    ticks = client_ticks(spark)
    out = run(live.sliding_rates(batched(spark, ticks, folder(), cuts, "trade_id"), ["exchange"], 10), spark, folder)
    got = live.latest(out, ["exchange", "sec"])
    want = rates.sliding_rate(rates.per_second(ticks, ["exchange"]), ["exchange"], 10)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_ticks_within_the_limit_change_the_windows_they_are_in(spark, folder):
    ticks = client_ticks(spark, 120, 3)
    # the order of arrival differs from that of time by up to five seconds
    late = ticks.withColumn("arrival", F.unix_millis("ts") + F.pmod(F.xxhash64("trade_id"), F.lit(5000)))
    stream = batched(spark, late, folder(), [20, 40, 60, 80, 100], "arrival")
    got = live.latest(run(live.sliding_rates(stream, ["exchange"], 7, late_s=6), spark, folder), ["exchange", "sec"])
    want = rates.sliding_rate(rates.per_second(ticks, ["exchange"]), ["exchange"], 7)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


class Held:
    """State of one kind in memory, as the state store hands it out."""

    def __init__(self):
        self.held = {}

    def get(self):
        return self.held.get("value")

    def update(self, value):
        self.held["value"] = value

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        return self.held.get(key)

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]

    def values(self):
        return iter(list(self.held.values()))

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))


class Handle:
    def __init__(self):
        self.states = {}

    def _new(self, name, *_):
        return self.states.setdefault(name, Held())

    getMapState = getValueState = _new


def test_the_ring_of_seconds_is_bounded():
    import pandas as pd

    handle = Handle()
    processor = live.RateProcessor(60, 0, ["exchange"], None)
    processor.init(handle)
    for start in range(0, 2000, 50):
        secs = pd.DataFrame({"sec": list(range(start, start + 50)) * 2})
        list(processor.handleInputRows(("B",), iter([secs]), None))
        assert len(handle.states["ring"].held) <= 60
    late = list(processor.handleInputRows(("B",), iter([pd.DataFrame({"sec": [3, 1000]})]), None))
    assert late == []  # older than the newest second, and no lateness allowed


def test_a_batch_of_the_fifo_writes_what_it_adds_or_drops():
    import pandas as pd

    handle = Handle()
    processor = dedup.FifoProcessor(20, ["ticker"], "n")
    processor.init(handle)
    memory, rng, n = fifo.Memory(20), np.random.default_rng(0), 0
    writes = []
    for state in handle.states.values():
        put = state.updateValue
        state.updateValue = lambda k, v, put=put: (writes.append(k), put(k, v))
    for batch in range(60):
        size = int(rng.integers(1, 40 if batch % 10 == 0 else 5))
        names = [f"k{v}" for v in rng.integers(0, 45, size)]
        pdf = pd.DataFrame({"ticker": names, "n": range(n, n + size)})
        n += size
        del writes[:]
        kept = pd.concat(processor.handleInputRows((0,), iter([pdf]), None))
        assert kept["ticker"].tolist() == [k for k in names if memory.admit(k)]
        assert len(writes) <= 2 * len(kept)
        head, tail = handle.states["ends"].get()
        assert list(memory.keys) == [handle.states["slots"].held[(i,)][0] for i in range(head, tail)]
        assert {k for (k,) in handle.states["places"].held} == set(memory.keys) and len(handle.states["slots"].held) == len(memory.keys)


def reset_events(spark, seed=2, n=120):
    ticks = client_ticks(spark, n, seed).select("exchange", "ts")
    start = ticks.agg(F.min("ts")).first()[0]
    rng = np.random.default_rng(seed)
    span = (ticks.agg(F.max("ts")).first()[0] - start).total_seconds()
    rows = [("AB"[i % 2], start + timedelta(seconds=round(float(s), 3))) for i, s in enumerate(rng.uniform(0, span, 9))]
    rows += [rows[0], ("B", ticks.where("exchange = 'B'").first()[1])]  # twice the same, and one at the time of a tick
    return ticks, spark.createDataFrame(rows, "exchange string, ts timestamp")


def epochs(ticks, resets):
    at = ticks.select("exchange", F.unix_millis("ts").alias("at"))
    since = resets.select("exchange", F.unix_millis("ts").alias("since")).distinct()
    hit = at.join(since, "exchange").where("since <= at").groupBy("exchange", "at").agg(F.max("since").alias("since"))
    counted = at.join(hit, ["exchange", "at"], "left").groupBy("exchange", "since").count()
    return {(r.exchange, r.since): r["count"] for r in counted.collect()}


@pytest.mark.parametrize("cuts", CUTS[1:3])
def test_counts_are_reset_while_running(spark, folder, cuts):
    ticks, resets = reset_events(spark)
    events = live.with_resets(ticks, resets, ["exchange"])
    out = run(live.resettable_counts(batched(spark, events, folder(), cuts, "at"), ["exchange"]), spark, folder)
    got = {(r.exchange, r.since): r.n for r in live.latest(out, ["exchange", "since"]).collect()}
    want = epochs(ticks, resets)
    assert {k: n for k, n in got.items() if n} == want
    now = {r.exchange: r.n for r in live.since_reset(out, ["exchange"]).collect()}
    for exchange in "AB":
        last = max(s for e, s in got if e == exchange and s is not None)
        assert now[exchange] == want.get((exchange, last), 0)


def test_late_resets_part_what_was_counted(spark, folder):
    ticks, resets = reset_events(spark, 5)
    events = live.with_resets(ticks, resets, ["exchange"])
    late = events.withColumn("arrival", F.col("at") + F.when(F.col("reset"), 20_000).otherwise(F.pmod(F.xxhash64("at"), F.lit(3000))))
    stream = batched(spark, late, folder(), list(range(10, 120, 10)), "arrival")
    out = run(live.resettable_counts(stream, ["exchange"], late_s=120), spark, folder)
    got = {(r.exchange, r.since): r.n for r in live.latest(out, ["exchange", "since"]).collect()}
    assert {k: n for k, n in got.items() if n} == epochs(ticks, resets)


def samples(spark, n=160, seed=4):
    rng = np.random.default_rng(seed)
    names = ["processor_channel_backlog", "ws_active_connections", "probe_success", "ticks_dropped_silently_total", "other"]
    rows, total = [], 0
    for i in range(n):
        name = names[int(rng.integers(len(names)))]
        total = 0 if rng.random() < 0.03 else total + int(rng.integers(0, 900_000))
        value = {0: int(rng.choice([40_000, 60_000, 120_000])), 1: int(rng.choice([0, 0, 2, 5])), 2: int(rng.integers(2)), 3: total}
        rows.append((name, "XY"[i % 2], BASE + timedelta(seconds=30 * i), Decimal(value.get(names.index(name), 1)), 'job="blackbox-health"' if i % 3 else None))
    return spark.createDataFrame(rows, SAMPLE)


@pytest.mark.parametrize(("cuts", "gap"), [(CUTS[0], None), (CUTS[3], None), (CUTS[3], 400)])
def test_streamed_alerts_equal_the_batch(spark, folder, cuts, gap):
    df = samples(spark).withColumn("labels", F.lit('job="blackbox-health"') if gap else F.lit('job="x"'))
    out = run(alerts.alerts(batched(spark, df, folder(), cuts, "ts"), ["exchange"], max_gap_s=gap), spark, folder)
    want = metrics.evaluate_rules(df, ["exchange"], max_gap_s=gap)
    got = out.where("event = 'sample'").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    # every state has its turn: a run is pending before it fires, and resolved at most once
    turns = {}
    for r in out.where("event <> 'sample'").orderBy("ts").collect():
        turns.setdefault((r.alertname, r.exchange, r.since), []).append(r.event)
    for events in turns.values():
        assert sorted(events, key=["pending", "firing", "resolved"].index) == events and len(set(events)) == len(events)
        assert events[0] == "pending"


def test_an_alert_fires_without_a_new_sample(spark, folder):
    rule = [("High", "warning", "load", ">", 10, 2)]
    at = lambda s: BASE + timedelta(seconds=s)
    rows = [("load", "X", at(0), Decimal(50), None), ("load", "Y", at(0), Decimal(5), None)]
    rows += [("load", "Y", at(s), Decimal(5), None) for s in (60, 121, 130)]  # only Y goes on, and moves the watermark
    rows += [("load", "X", at(200), Decimal(60), None), ("load", "X", at(210), Decimal(1), None)]
    df = spark.createDataFrame(rows, SAMPLE)
    out = run(alerts.alerts(batched(spark, df, folder(), [2, 3, 4, 5], "ts"), ["exchange"], rule), spark, folder)
    got = [(int((r.ts - BASE).total_seconds()), r.event, r.value) for r in out.where("exchange = 'X'").orderBy("ts", "event").collect()]
    assert got == [(0, "pending", 50.0), (120, "firing", 50.0), (200, "sample", 60.0), (210, "resolved", 1.0)]
    assert out.where("exchange = 'Y'").isEmpty()


class Counted(float):
    """A number that counts its additions."""

    added = 0

    def __add__(self, other):
        Counted.added += 1
        return Counted(float(self) + float(other))


def test_the_growth_of_a_window_is_not_added_up_anew():
    n, width, Counted.added = 3000, 1000, 0
    window = alerts.Growth(Counted(0))
    for ts in range(n):
        window.drop_until(ts - width)
        window.add(ts, Counted(ts % 7))
        if ts:
            first = max(0, ts - width + 1)
            assert len(window.entries) == ts - first + 1
            assert window.after_first() == sum(t % 7 for t in range(first + 1, ts + 1))
    assert Counted.added <= 4 * n
    assert [ts for ts, _ in alerts.Growth(0.0, window.entries).entries] == list(range(n - width, n))


def test_a_batch_of_the_fifo_is_held_packed_and_judged_in_pieces(monkeypatch):
    rows = [(i, "ab"[i % 2] if i % 5 else None, Decimal(i % 3)) for i in range(200)]
    frame = pd.DataFrame(rows, columns=["trade_id", "ticker", "price"])
    types = {"ticker": pa.large_string(), "price": pa.decimal128(18, 8)}
    packed = dedup.Packed(iter([frame[:90], frame[90:]]), types)
    assert packed.rows(np.arange(199, -1, -1)).values.tolist() == frame[::-1].values.tolist()
    assert all(isinstance(a, pa.Array) for a in packed.held.values()) and list(packed.plain) == ["trade_id"]
    monkeypatch.setattr(dedup, "PIECE", 16)
    seen = []
    job = dedup.FifoProcessor(3, ["ticker"], "trade_id", types)
    monkeypatch.setattr(job, "_admitted", lambda pdf: seen.append(pdf) or pdf)
    list(job.handleInputRows((0,), iter([frame[90:], frame[:90]]), None))
    assert max(map(len, seen)) == 16 and pd.concat(seen)["trade_id"].tolist() == list(range(200))
