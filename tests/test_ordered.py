"""Chunked windows against plain Python, with chunks small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from ticklake.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    # One key holds most rows; values may be null.
    rows = [
        (rnd.choice(["hot", "hot", "hot", "a", "b"]), i, rnd.choice([None, *range(-5, 6)])) for i in range(400)
    ]
    return rows, spark.createDataFrame(rows, "k string, seq bigint, v bigint").repartition(5).cache()


def by_key(rows):
    groups = {}
    for k, i, v in rows:
        groups.setdefault(k, []).append((i, v))
    return groups


@pytest.mark.parametrize("chunk", [1, 3, 50, 1000])
def test_running_sum_and_max(data, chunk):
    rows, df = data
    out = ordered.running_sum(df, ["k"], ["seq"], {"s": F.col("v")}, ordered.seq_chunk("seq", chunk))
    out = ordered.running_max(out, ["k"], ["seq"], {"m": F.col("v")}, ordered.seq_chunk("seq", chunk))
    got = {(r.k, r.seq): (r.s, r.m) for r in out.collect()}
    for k, items in by_key(rows).items():
        total, top = 0, None
        for i, v in items:
            total += v or 0
            top = v if top is None else (top if v is None else max(top, v))
            assert got[(k, i)] == (total, top)


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_previous_keeps_nulls(data, chunk):
    rows, df = data
    out = ordered.previous(df, ["k"], "seq", {"p": "v", "q": "seq"}, ordered.seq_chunk("seq", chunk))
    got = {(r.k, r.seq): (r.p, r.q) for r in out.collect()}
    for k, items in by_key(rows).items():
        before = (None, None)
        for i, v in items:
            assert got[(k, i)] == before
            before = (v, i)


def test_row_numbers_without_keys(data):
    rows, df = data
    out = ordered.row_numbers(df, [], ["seq"], "rn", ordered.seq_chunk("seq", 7))
    assert sorted((r.seq, r.rn) for r in out.collect()) == [(i, i + 1) for i in range(len(rows))]


@pytest.mark.parametrize("width,slot", [(1, 1), (5, 5), (5, 64), (30, 31)])
def test_sliding(data, width, slot):
    rows, df = data
    out = ordered.sliding(
        df, ["k"], "seq", width, {"n": lambda w: F.count("*").over(w), "s": lambda w: F.sum("v").over(w)}, slot
    )
    got = {(r.k, r.seq): (r.n, r.s) for r in out.collect()}
    assert len(got) == len(rows)
    for k, items in by_key(rows).items():
        for i, _ in items:
            frame = [v for j, v in items if i - width < j <= i]
            known = [v for v in frame if v is not None]
            assert got[(k, i)] == (len(frame), sum(known) if known else None)


def test_slot_shorter_than_frame_is_refused(data):
    with pytest.raises(ValueError):
        ordered.sliding(data[1], ["k"], "seq", 10, {}, slot=5)


@pytest.mark.parametrize("width", [1, 5, 64, 1000])
def test_sliding_sums(data, width):
    rows, df = data
    out = ordered.sliding_sums(df, ["k"], "seq", width, "v", "s", "f", "n")
    got = {(r.k, r.seq): (r.v, r.s, r.f, r.n) for r in out.collect()}
    assert len(got) == len(rows)
    for k, items in by_key(rows).items():
        for i, v in items:
            frame = [x for j, x in items if i - width < j <= i]
            known = [x for x in frame if x is not None]
            assert got[(k, i)] == (v, sum(known) if known else None, frame[0], len(frame))


def test_sliding_sums_of_odd_rows(spark):
    rows = [(None, -7, 1.0), (None, -3, float("nan")), (None, 2, 2.0), (None, 6, 4.0), (None, None, 9.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v double")
    got = {(r.k, r.seq): r for r in ordered.sliding_sums(df, ["k"], "seq", 5, "v", "s", "f", "n").collect()}
    assert set(got) == {(None, -7), (None, -3), (None, 2), (None, 6), ("a", 2)}
    # NaN is in the frames that hold it, and in no later one.
    assert got[(None, -3)].s != got[(None, -3)].s
    assert (got[(None, 2)].s, got[(None, 2)].f, got[(None, 2)].n) == (2.0, 2.0, 1)
    assert (got[(None, 6)].s, got[(None, 6)].f, got[(None, 6)].n) == (6.0, 2.0, 2)
    assert (got[("a", 2)].s, got[("a", 2)].f, got[("a", 2)].n) == (None, None, 1)
