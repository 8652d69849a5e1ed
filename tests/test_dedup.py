import random
from decimal import Decimal

import pytest

from ticklake.operators import dedup, fifo, joins
from ticklake.operators.fifo import Memory


def test_memory_forgets_the_oldest():
    m = Memory(3)
    assert [m.admit(k) for k in ("t1", "t2", "t3", "t4")] == [True] * 4
    assert list(m.keys) == ["t2", "t3", "t4"]
    assert not m.admit("t3") and m.admit("t1")


def test_memory_size_and_repeats():
    m = Memory(5)
    assert all(m.admit(i) for i in range(10)) and len(m.keys) == 5
    m = Memory(5)
    assert m.admit("x") and not m.admit("x") and len(m.keys) == 1
    m = Memory(0)
    assert not m.admit("x") and len(m.keys) == 0


def test_memory_forgets_a_tenth_at_once():
    m = Memory(20)
    for i in range(21):
        m.admit(i)
    assert list(m.keys) == list(range(2, 21))


def stream(n, keys, seed):
    rnd = random.Random(seed)
    return [("T%d" % rnd.randrange(keys), 1 + i, 1, rnd.randrange(4), "B") for i in range(n)]


def brute_force(rows, size, shard_of):
    memories, kept = {}, []
    for i, (t, _, _, s, x) in enumerate(rows):
        if memories.setdefault(shard_of(t), Memory(size)).admit((t, x, s)):
            kept.append(i)
    return kept


@pytest.mark.parametrize("size,shards", [(1, 1), (5, 1), (12, 3), (1000, 4)])
def test_fifo_matches_brute_force(spark, make_ticks, size, shards):
    from test_scalars import wrapped_hash

    rows = stream(600, 9, size)
    out = fifo.fifo_dedup(make_ticks(rows).repartition(7), size, shards, by="ticker")
    expected = brute_force(rows, size, lambda t: wrapped_hash(t) % shards)
    assert sorted(r.trade_id for r in out.collect()) == expected


def test_fifo_by_key_and_disabled(make_ticks):
    rows = stream(300, 5, 3)
    ticks = make_ticks(rows)
    whole = fifo.fifo_dedup(ticks, 10_000, 8)
    firsts = dedup.first_arrival(ticks)
    assert sorted(r.trade_id for r in whole.collect()) == sorted(r.trade_id for r in firsts.collect())
    assert fifo.fifo_dedup(ticks, 0, 4).count() == 300
    with pytest.raises(ValueError):
        fifo.with_shard(ticks, 2, "price")


def test_first_arrival_keeps_the_first(make_ticks):
    rows = [("A", 1, 1, 0, "B"), ("A", 2, 2, 0, "B"), ("A", 3, 3, 1, "B"), ("A", 4, 4, 0, "K")]
    out = {r.trade_id: r.price for r in dedup.first_arrival(make_ticks(rows)).collect()}
    assert out == {0: Decimal(1), 2: Decimal(3), 3: Decimal(4)}


def test_first_arrival_with_text_columns(spark):
    df = spark.createDataFrame([(1, "a", "late"), (0, "a", None), (2, "b", "x")], "trade_id long, k string, note string")
    out = sorted((r.trade_id, r.k, r.note) for r in dedup.first_arrival(df, ["k"]).collect())
    assert out == [(0, "a", None), (2, "b", "x")]


def test_mark_repeats(make_ticks):
    rows = [("A", 1, 1, 0, "B"), ("A", 1, 1, 0, "B"), ("A", 1, 1, 1, "B"), ("A", 1, 1, 0, "B")]
    marks = {r.trade_id: r.repeat for r in dedup.mark_repeats(make_ticks(rows)).collect()}
    assert marks == {0: False, 1: True, 2: False, 3: True}


def test_balance_of_the_published_run(spark):
    df = spark.createDataFrame([(1_700_000, 51_026, 1_648_973)], "batch_size long, cached long, inserted long")
    b = dedup.balance(df).first()
    assert (b.received, b.processed, b.dedup_cache, b.dedup_db, b.balanced) == (1_700_000, 1_648_973, 51_026, 1, True)
    share = {r.level: r.pct_of_removed for r in dedup.shares(dedup.balance(df)).collect()}
    assert round(share["cache"], 3) == 99.998


def test_existing_keys_exact_and_loose(spark, make_ticks):
    table = make_ticks([("A", 1, 1, 0, "B"), ("A", 1, 1, 1, "K"), ("C", 1, 1, 2, "B")])
    asked = make_ticks([("A", 1, 1, 0, "B"), ("C", 1, 1, 1, "K")])
    exact = {(r.ticker, r.exchange) for r in joins.existing_keys(table, asked).collect()}
    loose = {(r.ticker, r.exchange) for r in joins.existing_keys(table, asked, loose=True).collect()}
    assert exact == {("A", "B")}
    assert loose == {("A", "B"), ("A", "K")}


def test_salted_lookup_equals_plain(spark):
    left = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) as k")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "k string, v int")
    for how in ("inner", "left"):
        plain = joins.lookup(left, right, ["k"], how)
        salted = joins.lookup(left, right, ["k"], how, salts=8)
        assert plain.exceptAll(salted.select(*plain.columns)).isEmpty()
        assert plain.count() == salted.count()
    with pytest.raises(ValueError):
        joins.lookup(left, right, ["k"], "right")


def test_subscriptions(spark):
    readers = spark.createDataFrame([("binance", "btcusdt"), ("nowhere", "x")], "exchange string, symbol string")
    exchanges = spark.createDataFrame([("binance", "ws://h/ws/{Symbol}@trade")], "exchange string, url string")
    assert [r.url for r in joins.subscriptions(readers, exchanges).collect()] == ["ws://h/ws/btcusdt@trade"]

