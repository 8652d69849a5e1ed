"""Count-bounded first-in-first-out duplicate filter.

Each shard remembers the last ``size`` keys it let through. A key that is remembered is a
repeat; a repeat does not renew its place. When the memory is full, the oldest tenth of it
(at least one key) is forgotten before the next key is stored.

The result depends on the order of arrival within a shard, so a shard is worked through in
order. Spark does the sharding and the (spilling) sort; the Python part sees one Arrow batch
at a time and keeps ``size`` keys, however long the shard is. Sharding by the whole key (the
default) spreads a hot ticker over all shards; by ticker it matches consumers that each own
their tickers, and a hot ticker then makes one long shard.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ticklake.functions import shard
from ticklake.schemas import TICK_KEY

DEFAULT_SIZE = 6000


class Memory:
    """The keys one shard remembers, oldest first."""

    def __init__(self, size: int, keys: Sequence = ()):
        self.size = size
        self.keys = OrderedDict.fromkeys(keys)
        self.drop = max(1, size // 10)

    def admit(self, key) -> bool:
        """Store a key that is not remembered and return True; a size of 0 remembers nothing."""
        if self.size <= 0 or key in self.keys:
            return False
        if len(self.keys) >= self.size:
            for _ in range(min(self.drop, len(self.keys))):
                self.keys.popitem(last=False)
        self.keys[key] = None
        return True


def with_shard(df: DataFrame, shards: int, by: str = "ticker", key: Sequence[str] = TICK_KEY) -> DataFrame:
    """Add ``shard``: of the ticker, as consumers are assigned, or of the whole key."""
    if by == "ticker":
        number = shard(F.col("ticker"), shards)
    elif by == "key":
        number = F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")
    else:
        raise ValueError("shard by 'ticker' or 'key'")
    return df.withColumn("shard", number)


def fifo_dedup(
    df: DataFrame,
    size: int = DEFAULT_SIZE,
    shards: int = 64,
    by: str = "key",
    key: Sequence[str] = TICK_KEY,
    seq: str = "trade_id",
) -> DataFrame:
    """Rows that pass the filter, in batch. A size of 0 passes everything."""
    marked = with_shard(df, shards, by, key)
    if size <= 0:
        return marked
    schema = StructType(df.schema.fields + [StructField("shard", IntegerType(), True)])
    key = list(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, memory = None, None
        for pdf in frames:
            keep = []
            for s, k in zip(pdf["shard"], pdf[key].itertuples(index=False, name=None)):
                if s != current:
                    current, memory = s, Memory(size)
                keep.append(memory.admit(k))
            yield pdf[keep]

    # The shard number is the partition, so no two shards share a task while others are idle.
    ordered = marked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", seq)
    return ordered.mapInPandas(run, schema)
