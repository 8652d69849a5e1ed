"""Versions of the tick table: writers at once, merge on read, folding, pinned readers, vacuum."""

import threading
from datetime import timedelta
from decimal import Decimal

import pytest
from base import BASE

from ticklake import files, versions
from ticklake.schemas import RAW_TICK, TICK
from ticklake.sinks import versioned as vt


def ticks(spark, rows):
    """Ticks from (ticker, seconds after BASE, price), arriving in that order."""
    data = [(i, t, "B", Decimal(p), Decimal(1), BASE + timedelta(seconds=s)) for i, (t, s, p) in enumerate(rows)]
    return spark.createDataFrame(data, TICK)


def keys(spark, rows):
    return spark.createDataFrame([(t, "B", BASE + timedelta(seconds=s)) for t, s in rows], "ticker string, exchange string, ts timestamp")


def held(spark, path, version=None):
    return sorted(
        (r.ticker, int((r.ts - BASE).total_seconds()), int(r.price), r.normalized) for r in vt.read(spark, path, version).collect()
    )


DAY = 86400


def test_inserts_keep_what_is_there(spark, folder):
    path = folder()
    assert vt.read(spark, path).count() == 0 and vt.read(spark, path).schema.names == RAW_TICK.names
    first = vt.insert_new(spark, ticks(spark, [("A", 0, 1), ("A", 0, 2), ("B", DAY, 3)]), path)
    assert sorted(int(r.price) for r in first.collect()) == [1, 3]
    again = vt.insert_new(spark, ticks(spark, [("A", 0, 9), ("C", 5, 4)]), path)
    assert [int(r.price) for r in again.collect()] == [4]
    assert vt.insert_new(spark, ticks(spark, [("A", 0, 9)]), path).count() == 0
    assert held(spark, path) == [("A", 0, 1, False), ("B", DAY, 3, False), ("C", 5, 4, False)]
    assert versions.numbers(spark, path) == [1, 2]  # an insert of nothing makes no version


def test_edits_and_deletes_are_merged_on_read(spark, folder):
    path = folder()
    vt.insert_new(spark, ticks(spark, [("A", 0, 1), ("B", 0, 2), ("C", DAY, 3), ("D", DAY, 4)]), path)
    vt.mark_normalized(spark, path, keys(spark, [("A", 0), ("Z", 0)]))
    vt.delete_rows(spark, path, keys(spark, [("B", 0), ("C", DAY), ("C", DAY)]))
    assert held(spark, path) == [("A", 0, 1, True), ("D", DAY, 4, False)]
    # a deleted key may come again, and is not touched by the edits before it
    vt.insert_new(spark, ticks(spark, [("B", 0, 7), ("A", 0, 8)]), path)
    assert held(spark, path) == [("A", 0, 1, True), ("B", 0, 7, False), ("D", DAY, 4, False)]
    change = keys(spark, [("A", 0), ("B", 0)]).selectExpr("*", "cast(50 as decimal(18,8)) as price", "false as normalized")
    vt.update_rows(spark, path, change, ["price", "normalized"])
    vt.update_rows(spark, path, change.selectExpr("ticker", "exchange", "ts", "price + 1 as price").where("ticker = 'A'"), ["price"])
    want = [("A", 0, 51, False), ("B", 0, 50, False), ("D", DAY, 4, False)]
    assert held(spark, path) == want
    # every earlier version reads as it was
    assert held(spark, path, versions.at(spark, path, 2))[0] == ("A", 0, 1, True) and len(held(spark, path, versions.at(spark, path, 1))) == 4
    pinned = vt.read(spark, path)
    assert vt.fold(spark, path) is not None and vt.fold(spark, path) is None
    assert held(spark, path) == want and not versions.latest(spark, path).of(versions.EDITS)
    assert pinned.count() == 3  # its files are still there
    before = len(versions.numbers(spark, path))
    gone = versions.vacuum(spark, path, keep=1)
    assert before > 1 and versions.numbers(spark, path) == [before] and gone and held(spark, path) == want
    assert versions.vacuum(spark, path, keep=1) == []
    vt.delete_rows(spark, path, keys(spark, [("A", 0), ("B", 0), ("D", DAY)]))
    vt.fold(spark, path)
    assert held(spark, path) == [] and versions.latest(spark, path).entries == ()


def test_edits_write_less_than_days(spark, folder):
    path = folder()
    vt.insert_new(spark, ticks(spark, [(f"T{i % 50}", i, i) for i in range(20000)]), path)
    whole = files.size(spark, path)
    version = vt.mark_normalized(spark, path, keys(spark, [(f"T{i}", i) for i in range(50)]))
    edits = [e for e in version.entries if e.kind == versions.EDITS]
    assert sum(files.size(spark, f"{path}/{e.folder}") for e in edits) < whole / 20
    assert vt.read(spark, path).where("normalized").count() == 50


def test_two_edits_of_one_key_and_unknown_columns(spark, folder):
    path = folder()
    two = keys(spark, [("A", 0), ("A", 0)]).selectExpr("*", "true as normalized")
    with pytest.raises(ValueError, match="two edits"):
        vt.update_rows(spark, path, two, ["normalized"])
    with pytest.raises(ValueError, match="cannot set"):
        vt.update_rows(spark, path, two, ["ticker"])


def test_a_writer_that_lost_compares_again(spark, folder):
    path = folder()
    calls = []

    def other():
        if not calls:
            calls.append(1)
            vt.insert_new(spark, ticks(spark, [("A", 0, 100), ("B", 0, 100), ("X", 2 * DAY, 100)]), path)

    mine = vt.insert_new(spark, ticks(spark, [("A", 0, 1), ("C", 0, 1), ("D", DAY, 1)]), path, between=other)
    assert sorted(r.ticker for r in mine.collect()) == ["C", "D"]
    assert [r[:3] for r in held(spark, path)] == [("A", 0, 100), ("B", 0, 100), ("C", 0, 1), ("D", DAY, 1), ("X", 2 * DAY, 100)]
    assert len(versions.orphans(spark, path)) == 1  # what the loser wrote first


def test_many_writers_at_once(spark, folder):
    path = folder()
    errors = []

    def write(k):
        try:
            vt.insert_new(spark, ticks(spark, [("A", s, k) for s in range(10)] + [(f"own{k}", 0, k)]), path)
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    rows = held(spark, path)
    assert len(rows) == len({r[:2] for r in rows}) == 14
    assert versions.numbers(spark, path) == [1, 2, 3, 4]


def test_edits_and_inserts_during_a_fold(spark, folder):
    path = folder()
    vt.insert_new(spark, ticks(spark, [("A", 0, 1), ("B", 0, 2), ("C", 0, 3)]), path)
    vt.mark_normalized(spark, path, keys(spark, [("A", 0)]))

    def meanwhile():
        if len(versions.numbers(spark, path)) == 2:
            vt.delete_rows(spark, path, keys(spark, [("B", 0)]))
            vt.insert_new(spark, ticks(spark, [("D", 0, 4), ("B", 0, 5)]), path)

    vt.fold(spark, path, between=meanwhile)
    want = [("A", 0, 1, True), ("B", 0, 5, False), ("C", 0, 3, False), ("D", 0, 4, False)]
    assert held(spark, path) == want
    vt.fold(spark, path)
    assert held(spark, path) == want

    # two folds of the same days: the second starts anew and finds nothing to do
    vt.mark_normalized(spark, path, keys(spark, [("C", 0)]))
    ran = []

    def fold_too():
        if not ran:
            ran.append(1)
            vt.fold(spark, path)

    assert vt.fold(spark, path, between=fold_too) is None
    assert held(spark, path)[2] == ("C", 0, 3, True)


def test_many_small_commits_are_folded(spark, folder):
    path = folder()
    for i in range(4):
        vt.insert_new(spark, ticks(spark, [("A", i, i)]), path)
    assert vt.fold(spark, path, most_files=4) is None
    assert vt.fold(spark, path, most_files=3) is not None
    assert len(versions.latest(spark, path).entries) == 1 and len(held(spark, path)) == 4


def test_a_replayed_batch_is_known(spark, folder):
    path = folder()
    batch = ticks(spark, [("A", 0, 1), ("B", DAY, 2)])
    first = vt.insert_new(spark, batch, path, mark=("s", 0))
    vt.fold(spark, path, most_files=0)
    again = vt.insert_new(spark, batch, path, mark=("s", 0))
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in first.collect()) and again.count() == 2
    none = vt.insert_new(spark, batch, path, mark=("s", 1))
    assert none.count() == 0 and vt.insert_new(spark, batch, path, mark=("s", 1)).count() == 0
    assert versions.latest(spark, path).written("s", 1) and not versions.latest(spark, path).written("t", 0)
    with pytest.raises(ValueError, match="followed"):
        vt.insert_new(spark, batch, path, mark=("s", 0))


def test_a_flat_table_becomes_the_first_version(spark, folder):
    from ticklake.sinks.ticks import to_rows

    flat, path = folder(), folder()
    to_rows(ticks(spark, [("A", 0, 1), ("B", DAY, 2), ("C", 2 * DAY, 3)])).drop("dt").write.parquet(flat)
    assert vt.adopt(spark, spark.read.parquet(flat), path).number == 1 and vt.adopt(spark, spark.read.parquet(flat), path) is None
    assert [r[:3] for r in held(spark, path)] == [("A", 0, 1), ("B", DAY, 2), ("C", 2 * DAY, 3)]
    assert sorted(versions.latest(spark, path).days(versions.ROWS)) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert spark.read.parquet(flat).count() == 3  # the old table is untouched


def test_a_commit_is_refused_if_the_number_is_taken(spark, folder):
    path = folder()
    base = versions.latest(spark, path)
    versions.commit(spark, path, base)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, base)
    assert versions.numbers(spark, path) == [1] and all(n.endswith(".json") for n in files.names(spark, f"{path}/_versions"))


def test_the_rename_of_shared_file_systems_refuses_a_taken_name(spark, folder):
    from py4j.protocol import Py4JJavaError

    path = folder()
    for n in ("a", "b", "c"):
        files.write_text(spark, f"{path}/{n}", n)
    files.rename_new(spark, f"{path}/a", f"{path}/d")
    with pytest.raises(Py4JJavaError):
        files.rename_new(spark, f"{path}/b", f"{path}/c")
    assert files.read_text(spark, f"{path}/d") == "a" and files.read_text(spark, f"{path}/c") == "c"


def scanned(df):
    """(files, rows) that the scans of a plan read, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    out = [0, 0]
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        while "QueryStage" in leaf.nodeName():
            inner = leaf.plan().collectLeaves()
            leaf = inner.apply(0)
        held = leaf.metrics()
        for place, name in enumerate(("numFiles", "numOutputRows")):
            if held.contains(name):
                out[place] += held.apply(name).value()
    return tuple(out)


def test_look_ups_skip_files_and_row_groups(spark, folder):
    from ticklake.operators import joins, reads

    path, n = folder(), 6000
    for part in range(3):
        rows = [(f"T{i % 40}", part * n + i, 1) for i in range(n)]
        vt.insert_new(spark, ticks(spark, rows), path)
    table = vt.read(spark, path)
    assert scanned(table)[1] == 3 * n
    one = table.where("ticker = 'T7'").orderBy("ts").first()
    found = reads.by_id(table, one.id)
    assert found.first().ts == one.ts
    files_, rows_ = scanned(reads.by_id(table, one.id))
    assert rows_ <= n  # the files of the other commits were received at another time
    # folded into one set of files, the Bloom filter of the id tells an id that is not there
    vt.fold(spark, path, most_files=1)
    table = vt.read(spark, path)
    absent = one.id[:-4] + ("0000" if one.id[-4:] != "0000" else "1111")
    assert reads.by_id(table, one.id).first().ts == one.ts
    assert scanned(reads.by_id(table, absent))[1] == 0 and scanned(reads.by_id(table, absent, received=None))[1] == 0
    # a small batch of keys: pages of other tickers and times are skipped
    few = keys(spark, [("T3", 3), ("T5", 2 * n + 5), ("none", 1)])
    got = vt.find(spark, path, few)
    assert sorted(r.ticker for r in got.collect()) == ["T3", "T5"]
    part = joins.extent(few)
    assert len(part.instants) == 3 and part.names and vt.find(spark, path, few.where("false")).count() == 0
    assert vt.find(spark, path, keys(spark, [("T3", 40 * DAY), ("zzz", 5)])).count() == 0
    assert scanned(joins.extent(keys(spark, [("zzz", 5)])).of(table))[1] == 0  # another ticker
    assert scanned(joins.extent(keys(spark, [("T3", -5)])).of(table))[1] == 0  # another time


def test_an_insert_compares_with_what_can_hold_its_keys(spark, folder):
    path = folder()
    for day in range(4):
        vt.insert_new(spark, ticks(spark, [("A", day * DAY + i, i) for i in range(50)]), path)
    again = vt.insert_new(spark, ticks(spark, [("A", 2 * DAY + i, 9) for i in range(60)]), path)
    assert again.count() == 10 and vt.read(spark, path).count() == 210
    many = ticks(spark, [(f"T{i}", DAY, i) for i in range(600)])
    assert vt.insert_new(spark, many, path).count() == 600 and vt.insert_new(spark, many, path).count() == 0


def test_ingest_with_versions(spark, folder):
    from test_sources import trade

    from ticklake.sinks import candle_tiers
    from ticklake.streaming.ingest import Ingest

    job = Ingest("Binance", folder(), 60, keep_versions=True)
    values = [trade(T=1704103200000 + i * 10_000, t=i, s="BTC") for i in range(12)] + ["bad"]
    rows = spark.createDataFrame(list(enumerate(values)), "seq bigint, value string")

    class Crash(Exception):
        pass

    def crash(df, n, stream):
        raise Crash

    failing = Ingest("Binance", job.base, 60, candle_sink=crash, keep_versions=True)
    with pytest.raises(Crash):
        failing.batch(rows.where("seq < 6 or seq = 12"), 0)  # the ticks are in, the candles are not
    for _ in range(2):
        job.batch(rows.where("seq < 6 or seq = 12"), 0)
    job.batch(rows, 1)
    job.batch(rows, 2)
    assert vt.read(spark, job.tick_path).count() == 12
    assert [r.ticks for r in candle_tiers.read(spark, job.candle_path).orderBy("start_time").collect()] == [6, 6]
    assert spark.read.parquet(job.dead_path).count() == 3  # one for each batch
