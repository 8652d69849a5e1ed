"""Mergeable quantile sketches: exact counts, ranks within the bound, any order of merging."""

from datetime import timedelta

import numpy as np
from base import BASE
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ticklake.operators import sketches as sk

WANTED = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
KEYS = StructType([StructField("name", StringType())])


def samples(spark, n=40_000):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(100, n - 5), [float("nan"), 0.0, 0.0, 1e12, -3.0]])
    rows = [("ab"[i % 2], BASE + timedelta(seconds=i * 7), float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame([*rows, ("a", BASE, None), ("few", BASE, 1.0), ("few", BASE, 3.0)], "name string, ts timestamp, value double")


def off(values, x, q):
    """How far the ranks of a value are from q, as a part of all."""
    low, high = np.searchsorted(values, x, "left") / len(values), np.searchsorted(values, x, "right") / len(values)
    return max(low - q, q - high, 0.0)


def test_quantiles_are_within_the_bound_in_any_order(spark, folder):
    df, path = samples(spark).cache(), folder()
    held = {}
    for r in df.where("value is not null and not isnan(value)").collect():
        held.setdefault(r.name, []).append(r.value)
    for part in df.randomSplit([0.5, 0.3, 0.2], 3):  # slots come in several rows
        sk.write(sk.sketched(part, ["name"], slot_s=3600), path)
    stored = sk.read(spark, path, KEYS)
    assert stored.count() < df.count() / 50
    twice = sk.merged(stored.withColumn("half", F.pmod(F.xxhash64("slot"), F.lit(3))), ["name", "half"])  # merged in two steps
    for whole in (sk.quantiles(stored, ["name"], WANTED), sk.quantiles(twice.orderBy("half"), ["name"], WANTED)):
        rows = {r.name: r for r in whole.collect()}
        assert {k: r.n for k, r in rows.items()} == {k: len(x) for k, x in held.items()}
        for name, values in held.items():
            values = np.sort(values)
            assert all(off(values, rows[name][c], q) <= 2 * sk.rank_error() for c, q in WANTED.items())
        assert rows["few"].p50 in (1.0, 3.0) and rows["few"].p99 == 3.0


def test_a_range_reads_its_slots_only(spark, folder):
    df, path = samples(spark).where("value is not null and not isnan(value)"), folder()
    sk.write(sk.sketched(df, ["name"], slot_s=60), path)
    start, end = BASE + timedelta(hours=5), BASE + timedelta(hours=30)
    part = sk.read(spark, path, KEYS, start, end)
    want = df.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).groupBy("name").count()
    assert {r.name: r.n for r in sk.merged(part, ["name"]).collect()} == {r.name: r["count"] for r in want.collect()}
    assert "PartitionFilters: [isnotnull(dt" in part._jdf.queryExecution().executedPlan().toString()
    assert sk.sketched(df.where("false"), ["name"]).count() == 0
