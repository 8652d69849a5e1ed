"""Every registered query against its SQL twin; those without one must give rows."""

import pytest
from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

SQL = oracle_sql()
MAY_BE_EMPTY = {"rq_range_1h", "met20_candles_sound", "met19_drop_warning"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, sf, name):
    fn = queries()[name]
    if name not in SQL:
        assert fn(spark, sf).count() > 0
        return
    difference = compare(spark, con, fn, SQL[name], sf)
    if difference == "EMPTY":
        assert name in MAY_BE_EMPTY
    else:
        assert difference is None, difference


def test_the_status_report_counts_all_ticks(spark, sf):
    got = {r.exchange: r.ticks for r in queries()["join07_status_report_all"](spark, sf).collect()}
    assert sum(got.values()) == spark.read.parquet(f"{sf}/events.parquet").count() and min(got.values()) > 0
