"""Mixing by curriculum against a plain water-fill, and the schedule's integral and its inverse."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ticklake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share, stop at the limit, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_ and rest > 1e-9:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + unit * weight[s] > most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += unit * weight[s]
            break
        for s in full:
            rest -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= full
    return target


def check(docs):
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    got = mixing.plan(mixing.sizes(docs)).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=str) == sorted(rows, key=str)
    want, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert r.taken == r.times * r["size"] and 0 <= r.times <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.plan(mixing.sizes(docs.repartition(7))).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.times)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_documents(documents):
    check(documents)


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_empty(no_docs):
    assert mixing.plan(mixing.sizes(no_docs)).count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_no_words(make_docs):
    got = mixing.plan(mixing.sizes(make_docs([(1, None, "en", "a"), (2, "", "en", "b")]))).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0)] * 2


def test_mixed_rows_follow_the_plan(documents):
    plan = {r.doc_id: r.times for r in mixing.plan(mixing.sizes(documents)).collect()}
    out = mixing.mix(documents)
    assert out.columns == documents.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in plan.items() if n}


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.0))])
def test_inverse_of_the_integral(spark, schedule):
    whole = mixing.area(schedule)

    def used(t):
        done = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            done += x * (w0 + (w0 + (w1 - w0) * x / (t1 - t0))) / 2
        return done / whole

    rows = spark.range(101).select((F.col("id") / 100.0).alias("u"))
    for r in rows.select("u", mixing.when_reached(F.col("u"), schedule).alias("t")).collect():
        assert used(r.t) == pytest.approx(r.u, abs=1e-9)


def test_positions_follow_the_schedule(documents):
    plan = mixing.plan(mixing.sizes(documents))
    rows = mixing.positions(plan).collect()
    for kind, schedule in enumerate(mixing.SCHEDULES):
        mine = [r for r in rows if r.kind == kind]
        first_half = sum(r["size"] for r in mine if r.position <= 0.5)
        whole = sum(r["size"] for r in mine)
        at_half = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]) if b[0] <= 0.5)
        if any(t == 0.5 for t, _ in schedule):
            assert abs(first_half / whole - at_half / mixing.area(schedule)) < 0.1


def test_weights_are_the_integrals_of_the_schedules(make_docs):
    docs = make_docs([(i, "w " * 50, "en", "abc"[i % 3]) for i in range(60)])
    flat = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 0.0)))  # all of weight one
    assert {r.target for r in mixing.plan(mixing.sizes(docs), schedules=flat).collect()} == {1500.0}
    heavy = (((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)))  # two, one, one
    got = {r.source: r.target for r in mixing.plan(mixing.sizes(docs), schedules=heavy, share=1.0).collect()}
    assert got == {"a": 1500.0, "b": 750.0, "c": 750.0}


def test_the_query_s_positions(spark, sf):
    from ticklake.llm.queries import QUERIES

    rows = QUERIES["op4_mix_sources"](spark, sf).collect()
    seen = [r.first_position for r in rows if r.times]
    assert seen == sorted(seen) and all(0 <= p <= 1 for p in seen)  # in training order
    for r in rows:
        assert (r.first_position is None) == (r.last_position is None) == (r.times == 0)
        assert not r.times or (r.first_position < r.last_position if r.times == 2 else r.first_position == r.last_position)
