"""The shape of physical plans: what must be there at scale, and what must not."""

import re

import pytest
from __spark_entry__ import queries

from ticklake.operators import candles, dedup, reads
from ticklake.plans import views as v
from ticklake.sinks import ticks as sink
from ticklake.sources.tables import read_ticks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, sf):
    from ticklake.session import scratch

    path = scratch(spark, "plans")
    sink.insert_ignore(spark, v.ticks(spark, sf), path)
    return read_ticks(spark, path)


def test_range_read_prunes_days_and_pushes_filters(table):
    p = plan(reads.ticker_range(table, "CLICK", *v.DAY))
    assert re.search(r"PartitionFilters: \[[^\]]*dt#", p)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(ticker,CLICK\)", p)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", p)


def test_an_insert_lists_only_its_days(spark, table):
    from datetime import date

    from ticklake.sources.tables import read_days

    path = table.inputFiles()[0].split("/dt=")[0]
    one = read_days(spark, path, [date(2024, 1, 10), date(1999, 1, 1)])
    assert all("dt=2024-01-10" in f for f in one.inputFiles())
    assert one.select("dt").distinct().count() == 1 and one.count() == table.where("dt = '2024-01-10'").count()
    assert read_days(spark, path, [date(1999, 1, 1)]).isEmpty()


def test_count_reads_two_columns(table):
    p = plan(reads.count_range(table, "CLICK", *v.DAY))
    assert re.search(r"ReadSchema: struct<ticker:string,ts:timestamp>", p)


def test_newest_is_a_top_k(table):
    assert "TakeOrderedAndProject" in plan(reads.newest(table, "CLICK", 1000))


def test_candles_are_one_shuffle_of_partial_hash_aggregates(spark, sf):
    p = plan(candles.ohlcv(v.ticks(spark, sf), 60))
    assert p.count("Exchange ") == 1 and p.count("HashAggregate") == 2
    assert "SortAggregate" not in p and "Window" not in p and "Python" not in p
    by_time = plan(candles.ohlcv(v.ticks(spark, sf), 60, order="event_time"))
    assert by_time.count("HashAggregate") == 2 and "SortAggregate" not in by_time


def test_first_arrival_combines_before_the_shuffle(spark, sf):
    p = plan(dedup.first_arrival(v.arrivals(spark, sf)))
    assert p.count("Exchange ") == 1 and p.count("HashAggregate") == 2 and "Window" not in p


def test_nothing_multiplies_rows_by_rows(spark, sf):
    for name in ("join03_subscriptions", "met11_symbol_shares", "met15_channel_shares", "join04_help_and_type"):
        p = plan(queries()[name](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_python_only_where_order_needs_it(spark, sf):
    for name in ("src01_trade_messages", "src08_metric_text", "win02_sliding_rate_60s", "met08_balance"):
        assert "Python" not in plan(queries()[name](spark, sf)), name
    assert "MapInPandas" in plan(queries()["str06_fifo_batch"](spark, sf))
