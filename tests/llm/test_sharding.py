"""Sampled splitters: equal sizes, copies together, gapless slots."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ticklake.llm import sharding


def check(docs, shards=16, near=None, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sharding.shard(docs, shards, **options).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    held, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r["size"]].add(r.shard)
        assert 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    share = sum(held.values()) / shards
    if near is not None:
        assert all(abs(held[s] - share) <= near * share for s in range(shards))
    return groups, share


def test_documents(documents):
    groups, share = check(documents)
    assert sum(len(s) > 1 for s in groups.values()) <= sum(size > 0.05 * share / 2 for (_, size), _ in groups.items())


def test_equal_sizes_and_copies_together(make_docs):
    rows = [(i, f"text {i % 1500} " + "x" * (i % 97), "en", "a") for i in range(4000)]
    groups, _ = check(make_docs(rows), near=0.06)
    assert all(len(s) == 1 for s in groups.values())


def test_a_group_with_most_rows_is_spread(make_docs):
    rows = [(i, "the same text" if i % 3 else f"text {i}" + "y" * (i % 50), "en", "a") for i in range(3000)]
    groups, _ = check(make_docs(rows), near=0.25)
    assert max(map(len, groups.values())) > 4


def test_overfull_ranges_are_subdivided(spark):
    # one draw per range at first: the splitters are poor and have to be mended
    groups = spark.range(20000).select(F.xxhash64("id").alias("key"), (F.lit(1) + F.col("id") % 50).cast("long").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0]
    splitters, held = sharding.ranges(groups, total, 40, draws=1)
    assert sum(held) == total and max(held) <= 2 * total / 40 and splitters == sorted(set(splitters))


def test_odd_rows(odd_docs):
    check(odd_docs)
    check(odd_docs, shards=3)


def test_empty(no_docs):
    assert sharding.shard(no_docs).count() == 0
