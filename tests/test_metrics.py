from datetime import timedelta

import pytest
from base import BASE
from pyspark.sql import functions as F

from ticklake.operators import counts, metrics, rates, runs


def series(spark, points, name="s"):
    """Samples (series, ts, value) from (seconds, value)."""
    return spark.createDataFrame(
        [(name, BASE + timedelta(seconds=s), float(v)) for s, v in points], "series string, ts timestamp, value double"
    )


def test_sliding_rate_divides_by_seconds_with_traffic(spark):
    counts_ = spark.createDataFrame([("x", 0, 10), ("x", 1, 20), ("x", 9, 30), ("x", 10, 40), ("x", 75, 5)],
                                    "k string, sec long, n long")
    out = {r.sec: r.rate for r in rates.sliding_rate(counts_, ["k"], 10).collect()}
    assert out == {0: 10.0, 1: 15.0, 9: 20.0, 10: 30.0, 75: 5.0}
    wide = {r.sec: r.rate for r in rates.sliding_rate(counts_, ["k"], 500).collect()}
    assert wide[75] == 21.0 and wide[10] == 25.0
    assert {r.rate for r in rates.sliding_rate(counts_, ["k"], 0).collect()} == {0.0}


def test_counter_rate_survives_resets(spark):
    df = series(spark, [(0, 100), (60, 160), (120, 10), (180, 40), (900, 50)])
    out = {(r.ts - BASE).seconds: r.rate for r in metrics.counter_rate(df, ["series"], 300).collect()}
    assert out[0] is None and out[60] == pytest.approx(60 / 300)
    assert out[120] == pytest.approx(70 / 300) and out[180] == pytest.approx(100 / 300)
    assert out[900] is None


def test_counter_rate_adds_no_frame_up_anew(spark):
    # A frame that starts a number of units back is summed for each of its rows: the square of the samples in it.
    df = series(spark, [(s, s * s % 17) for s in range(0, 3000, 7)])
    rated = metrics.counter_rate(df, ["series"], 300)
    assert "RangeFrame, -" not in rated._jdf.queryExecution().analyzed().toString()
    points = [(s, s * s % 17) for s in range(0, 3000, 7)]
    grow = [0] + [b - a if b >= a else b for (_, a), (_, b) in zip(points, points[1:])]
    got = {(r.ts - BASE).seconds: r.rate for r in rated.collect()}
    for i, (s, _) in enumerate(points):
        frame = [g for (t, _), g in zip(points, grow) if s - 300 < t <= s]
        assert got[s] == (pytest.approx(sum(frame[1:]) / 300) if len(frame) > 1 else None)


def test_held_for_needs_an_unbroken_run(spark):
    points = [(0, 1), (60, 9), (120, 9), (180, 9), (240, 1), (300, 9), (360, 9), (7200, 9)]
    held = metrics.held_for(series(spark, points), ["series"], F.col("value") > 5, 120, slot_s=100)
    out = {int((r.ts - BASE).total_seconds()): (r.active, r.since, r.firing) for r in held.collect()}
    assert [s for s, r in sorted(out.items()) if r[2]] == [180, 7200]
    assert out[180][1] == BASE + timedelta(seconds=60) and out[7200][1] == BASE + timedelta(seconds=300)
    assert out[240] == (False, None, False)


def test_gaps_break_a_run(spark):
    points = [(0, 9), (60, 9), (7200, 9), (7260, 9), (7400, 9)]
    held = metrics.held_for(series(spark, points), ["series"], F.col("value") > 5, 120, slot_s=100, max_gap_s=300)
    out = {int((r.ts - BASE).total_seconds()): (int((r.since - BASE).total_seconds()), r.firing) for r in held.collect()}
    assert out == {0: (0, False), 60: (0, False), 7200: (7200, False), 7260: (7200, False), 7400: (7200, True)}


def test_null_series_stay(spark):
    df = series(spark, [(0, 1), (60, 5), (120, 9)]).withColumn("series", F.lit(None).cast("string"))
    assert metrics.counter_rate(df, ["series"], 300).count() == 3
    assert rates.deltas(df, ["series"]).where("delta is not null").count() == 2
    held = metrics.held_for(df, ["series"], F.col("value") > 2, 60)
    assert [r.firing for r in held.orderBy("ts").collect()] == [False, False, True]


def test_nan_breaks_no_limit(spark):
    df = spark.createDataFrame([(float("nan"),), (9.0,), (1.0,)], "value double")
    assert df.where(metrics.breaches(F.col("value"), ">", 5)).count() == 1


def test_no_job_runs_while_plans_are_built(spark):
    df = series(spark, [(0, 1), (60, 5)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        metrics.counter_rate(df, ["series"], 300)
        metrics.held_for(df, ["series"], F.col("value") > 2, 60)
        rates.deltas(df, ["series"])
        assert len(tracker.getJobIdsForGroup("building")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(k, x) for k in ("a", None) for x in (5, 1, 2, 2, 9, None)], "k string, x int")
    out = metrics.exact_quantiles(df, ["k"], "x", {"lo": 0.1, "mid": 0.5, "hi": 1.0}).collect()
    assert {(r.k, r.lo, r.mid, r.hi) for r in out} == {("a", 1, 2, 9), (None, 1, 2, 9)}


def test_alert_rules(spark):
    def rows(metric, values):
        return [(metric, "binance", BASE + timedelta(minutes=i), float(v)) for i, v in enumerate(values)]

    data = (
        rows("processor_channel_backlog", [60_000, 60_000, 120_000, 120_000, 120_000, 0])
        + rows("ws_active_connections", [3, 0, 0, 0, 0, 0])
        + rows("ticks_dropped_silently_total", [0, 600_000, 1_200_000, 1_800_000, 2_400_000, 2_400_000])
        + rows("exceptions_total", [0] * 6)
        + rows("probe_success", [1, 1, 0, 0, 0, 1])
        + rows("unrelated", [1] * 6)
    )
    samples = spark.createDataFrame(data, "metric string, exchange string, ts timestamp, value double")
    job = F.when(F.col("metric") == "probe_success", 'x="1",job="blackbox-health"').otherwise("")
    firing = metrics.evaluate_rules(samples.withColumn("labels", job), ["exchange"])
    unlabelled = metrics.evaluate_rules(samples, ["exchange"])
    assert unlabelled.where("alertname = 'MarketDataWorkerUnhealthy'").isEmpty() and unlabelled.count() > 0
    out = {}
    for r in firing.collect():
        out.setdefault(r.alertname, set()).add(int((r.ts - BASE).total_seconds() // 60))
    assert out == {
        "MarketDataChannelBacklogHigh": {2, 3, 4},
        "MarketDataChannelBacklogCritical": {4},
        "MarketDataTicksDropped": {3, 4, 5},
        "MarketDataAllWebSocketsDown": {4, 5},
        "MarketDataWorkerUnhealthy": {4},
    }
    groups = {(r.alertname, r.severity): r.n for r in metrics.alert_groups(firing).collect()}
    assert groups[("MarketDataChannelBacklogCritical", "critical")] == 1


def test_health_deltas(spark):
    rows = [(i, b, d) for i, (b, d) in enumerate([(5, 0), (5, 3), (2, 1), (2, 4), (9, 4)])]
    df = spark.createDataFrame([(BASE + timedelta(hours=i), b, d) for i, b, d in rows], "ts timestamp, backlog long, dropped long")
    out = [(r.backlog_delta, r.dropped_delta) for r in rates.health_deltas(df).orderBy("ts").collect()]
    assert out == [(5, None), (None, 3), (-3, None), (None, 1), (7, None)]


def test_marks_and_every_nth(spark):
    df = spark.createDataFrame([(i, 7) for i in range(20)], "batch_id long, inserted long")
    marks = [r.total for r in rates.progress_marks(df, 20).orderBy("batch_id").collect()]
    assert marks == [t for t in range(7, 141, 7) if t % 20 < 7]
    assert [r.batch_id for r in rates.every_nth(df, 6).orderBy("batch_id").collect()] == [5, 11, 17]
    assert rates.every_nth(df, 1).count() == 20


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 7, 50)] + [("b", 200.0)], "k string, x double")
    h = metrics.observe(df, ["k"], "x", [2.0, 5.0, 10.0])
    a = [(r.le, r.cumulative) for r in h.where("k = 'a'").orderBy("le").collect()]
    assert a == [(2.0, 2), (5.0, 3), (10.0, 4), (float("inf"), 5)]
    mean = {r.k: r.mean for r in metrics.histogram_means(h, ["k"]).collect()}
    assert mean == {"a": 63 / 5, "b": 200.0}
    q = {r.k: r.quantile for r in metrics.histogram_quantile(h, ["k"], 0.5).collect()}
    assert q["a"] == pytest.approx(2 + 3 * 0.5) and q["b"] == 10.0
    low = {r.k: r.quantile for r in metrics.histogram_quantile(h, ["k"], 0.0).collect()}
    assert low == {"a": 0.0, "b": 10.0}
    nulls = df.union(spark.createDataFrame([("a", None)], "k string, x double"))
    assert metrics.observe(nulls, ["k"], "x", [2.0, 5.0, 10.0]).exceptAll(h).isEmpty()


def test_gauges_and_drain(spark):
    df = spark.createDataFrame(
        [(BASE + timedelta(minutes=i), v) for i, vs in enumerate([(0, 0), (5, 3), (0, 1), (0, 0), (2, 0)]) for v in vs],
        "ts timestamp, value long",
    )
    totals = metrics.gauge_totals(df)
    assert [r.drained for r in totals.orderBy("ts").collect()] == [True, False, False, True, False]
    assert metrics.drain_time(totals).first().drained_at == BASE + timedelta(minutes=3)
    absent = metrics.gauge_totals(df.where("value > 99"), by=[]).first()
    assert absent.samples == 0 and absent.drained is None


def test_health(spark):
    def parts(*statuses):
        return spark.createDataFrame([("c", s) for s in statuses], "name string, status string")

    def clients(*flags):
        return spark.createDataFrame([(f,) for f in flags], "connected boolean")

    def state(p, c):
        r = metrics.health(p, c).first()
        return r.status, r.websocket

    assert state(parts("healthy", "disabled", "unknown", None), clients(True, False)) == ("healthy", "healthy")
    assert state(parts("healthy"), clients(False, False)) == ("degraded", "unhealthy")
    assert state(parts("unhealthy"), clients(True)) == ("degraded", "healthy")
    assert state(parts(), clients()) == ("healthy", "unknown")


def test_status(spark):
    log = spark.createDataFrame([(1, "B", "Connected"), (2, "B", "Disconnected"), (3, "K", "Connected")],
                                "seq long, exchange string, status string")
    listed = spark.createDataFrame([("B",), ("Z",)], "exchange string")
    assert {tuple(r) for r in counts.status_of(listed, log).collect()} == {("B", "Disconnected"), ("Z", "Disconnected")}
    ticks = spark.createDataFrame([("K",), ("K",), ("Z",)], "exchange string")
    assert {tuple(r) for r in counts.status_report(log, ticks).collect()} == {("B", "Disconnected", 0), ("K", "Connected", 2)}
    active = {r.seq: r.active for r in rates.active_connections(log).collect()}
    assert active == {1: 1, 2: 0, 3: 1}
    assert {tuple(r) for r in counts.per_exchange_of(listed, ticks).collect()} == {("B", 0), ("Z", 1)}


def test_fill_and_shares(spark):
    df = spark.createDataFrame(
        [(0, BASE, 10, 100), (0, BASE + timedelta(1), 50, 100), (1, BASE, 25, 100)],
        "channel int, ts timestamp, count long, capacity long",
    )
    assert {r.channel: r.fill_pct for r in metrics.fill_levels(df).collect()} == {0: 50.0, 1: 25.0, None: 37.5}
    b = spark.createDataFrame([(0, 75), (1, 25)], "channel int, batch_size long")
    assert {r.channel: (r.pct, r.imbalance) for r in metrics.channel_shares(b).collect()} == {0: (75.0, 1.5), 1: (25.0, 0.5)}
    idle = spark.createDataFrame([(0, 0), (1, 0)], "channel int, batch_size long")
    assert {(r.total, r.pct) for r in metrics.channel_shares(idle).collect()} == {(0, None)}


def test_run_reports(spark):
    rows = [(1, "copy", "Parallel", 500, 10.0), (2, "copy", "Sequential", 1000, 5.0), (3, "insert", "Sequential", 500, 9.0),
            (4, "copy", "Sequential", 500, 9.0)]
    df = spark.createDataFrame(rows, "run_id long, method string, mode string, chunk_size int, ticks_per_sec double")
    assert [r.run_id for r in runs.report_order(df).collect()] == [4, 2, 1, 3]
    assert {r.mode: r.run_id for r in runs.best_per_mode(df).collect()} == {"Parallel": 1, "Sequential": 3}


def test_estimated_drops(spark):
    df = spark.createDataFrame([(100, 80, 30), (500, 100, 50)], "incoming long, received long, queued long")
    out = [(r.backlog, r.dropped) for r in metrics.estimated_drops(df).orderBy("incoming").collect()]
    assert out == [(20, 0), (400, 350)]
    assert metrics.drop_warnings(df).count() == 1
