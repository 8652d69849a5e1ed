"""Sharding to equal sizes by sampled splitters.

1. Texts are hashed to a key; copies share it. Keys are combined to (key, bytes, rows).
2. A sample of keys, drawn in proportion to their bytes, gives quantile boundaries: ranges of keys
   of about the same size. The bytes of every range are counted over all rows; a range over twice
   its share is sampled again inside and subdivided, until it is not overfull or is a single key.
3. Running sums inside the ranges, with the exact total of the ranges before, give every key its
   place on a line of all bytes, cut into equal shards. A key goes where its middle lies.
4. A key larger than ``tolerance`` of a shard is subdivided: its rows are spread over its piece of
   the line by a hash of their id. So copies stay together, except for groups that would unbalance
   a shard.
5. Rows are numbered inside their shard in chunks.

The sample (a few thousand 64-bit keys, whatever the input) and one total per range are all that
reaches the driver. Draws are made by hashing, so a repeated task draws the same.

Edge cases: a null text has size 1 and crc32 0 like an empty one; null ids sort first; repeated rows
count and are numbered one by one; an empty table gives no rows; further columns are ignored; with
fewer keys than shards, some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm.common import numbered
from ticklake.session import cut

#: Ranges per shard, draws per range, and the part of a shard that a group of copies may fill unsplit.
RANGES_PER_SHARD, DRAWS, TOLERANCE = 16, 32, 0.05
ROUNDS = 8
_UNIT = 1.0 / (1 << 53)


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) fixed by the row."""
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit("draw"), *columns), F.lit(11)) * F.lit(_UNIT)


def range_of(key: Column, splitters: list[int]) -> Column:
    """Number of the range that a key falls into: splitters are the last keys of their ranges."""
    edges = np.array(splitters, dtype=np.int64)

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), side="left").astype(np.int32))

    return find(key)


def _draw(groups: DataFrame, rate: Column) -> list[tuple[int, int]]:
    """Sampled (key, draws): a key is drawn in proportion to its bytes."""
    draws = F.floor(F.col("bytes") * rate + uniform(F.col("key"), F.col("_round")))
    return [(r.key, r.draws) for r in groups.select("key", draws.alias("draws")).where("draws > 0").collect()]


def _quantiles(drawn: list[tuple[int, int]], ranges: int) -> list[int]:
    drawn.sort()
    weight = np.cumsum([d for _, d in drawn])
    if not len(weight):
        return []
    at = np.searchsorted(weight, np.arange(1, ranges) * (weight[-1] / ranges), side="left")
    return sorted({drawn[min(i, len(drawn) - 1)][0] for i in at})


def ranges(groups: DataFrame, total: int, wanted: int, draws: int = DRAWS) -> tuple[list[int], list[int]]:
    """(splitters, bytes per range) for keys (key, bytes); no range of several keys is overfull."""
    share = total / wanted
    drawn = _draw(groups.withColumn("_round", F.lit(0)), F.lit(wanted * draws / total))
    splitters = _quantiles(drawn, wanted)
    held: dict[int, int] = {}
    for turn in range(1, ROUNDS + 1):
        counted = groups.groupBy(range_of(F.col("key"), splitters).alias("range")).agg(
            F.sum("bytes").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        rows = counted.collect()  # one row per range
        held = {r.range: r.bytes for r in rows}
        overfull = {r.range: r.bytes for r in rows if r.bytes > 2 * share and r.low != r.high}
        if not overfull or turn == ROUNDS:
            break
        inside = groups.withColumn("range", range_of(F.col("key"), splitters)).where(F.col("range").isin(list(overfull)))
        new: set[int] = set()
        found: dict[int, list[tuple[int, int]]] = {}
        edges = np.array(splitters, dtype=np.int64)
        for key, n in _draw(inside.withColumn("_round", F.lit(turn)), F.lit(draws / share)):
            found.setdefault(int(np.searchsorted(edges, key, side="left")), []).append((key, n))
        for number, drawn in found.items():
            new.update(_quantiles(drawn, int(np.ceil(overfull[number] / share))))
        if new <= set(splitters):
            break  # what is left are keys that no splitter can cut
        splitters = sorted({*splitters, *new})
    return splitters, [held.get(i, 0) for i in range(len(splitters) + 1)]


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("key"),
        ),
        "rows",
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    splitters, held = ranges(groups, total, shards * ranges_per_shard)
    base = spark.createDataFrame(
        [(i, int(b)) for i, b in enumerate(np.cumsum([0, *held[:-1]]))], "range int, base long"
    )
    before = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ranged = groups.withColumn("range", range_of(F.col("key"), splitters))
    local = ranged.withColumn("_before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # One row per range: the number of ranges is a parameter, not a matter of the input.
    line = local.join(F.broadcast(base), "range").select("key", "bytes", "n", (F.col("base") + F.col("_before")).alias("start"))
    split = (F.col("bytes") > tolerance * total / shards) & (F.col("n") > 1)
    into = F.when(split, uniform(F.col("doc_id"), F.col("key"))).otherwise(F.lit(0.5))
    place = F.col("start") + F.col("bytes") * into
    number = F.least(F.floor(place * shards / total), F.lit(shards - 1)).cast("int")
    placed = rows.join(line, "key").select("doc_id", "size", "text_crc32", number.alias("shard"))
    return numbered(cut(placed, "placed"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
