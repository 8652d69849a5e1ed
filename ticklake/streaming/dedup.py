"""Duplicate removal on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

from ticklake import files
from ticklake.operators.dedup import first_arrival
from ticklake.operators.fifo import DEFAULT_SIZE, with_shard
from ticklake.schemas import TICK_KEY
from ticklake.session import adaptive

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def first_arrivals(
    ticks: DataFrame,
    path: str,
    checkpoint: str,
    key: Sequence[str] = TICK_KEY,
    seq: str = "trade_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """The first tick of each key, however late it comes; nothing is lost or forgotten.

    The output table is the memory: a batch keeps its smallest arrival number per key and appends
    the keys that no other batch has. Rows lie by day, stream and batch; only the days of a batch
    are compared, and a replayed batch overwrites its own folders. ``read_first_arrivals`` reads them.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = files.stream_id(spark, checkpoint)
        with adaptive(spark):
            rows = first_arrival(batch, key, seq).withColumn("dt", F.to_date("ts"))
            days = [r.dt for r in rows.select("dt").distinct().collect()]  # bounded by the calendar
            if files.has_data(spark, path):
                own = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
                held = _stored(spark, path, batch.schema).where(F.col("dt").isin(days) & ~own)
                match = [rows[c].eqNullSafe(held[c]) for c in key]
                rows = rows.join(held, reduce(lambda a, b: a & b, match), "left_anti")
            marked = rows.withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            marked.hint("rebalance", F.col("dt")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("dt", "stream", "batch_id").parquet(path)

    return (
        ticks.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    where = [StructField("dt", DateType()), StructField("stream", StringType()), StructField("batch_id", LongType())]
    return spark.read.schema(StructType(schema.fields + where)).parquet(path)


def read_first_arrivals(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return _stored(spark, path, schema).select(*schema.names)


def within_watermark(ticks: DataFrame, delay: str = "10 minutes", key: Sequence[str] = TICK_KEY) -> DataFrame:
    """One tick of each key, without a table: for streams that may lose late ticks.

    A key is remembered for ``delay`` of event time. Ticks later than that are dropped, unique or
    not, and which copy stays is open; ``first_arrivals`` has neither limit.
    """
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def packed_type(field: StructField) -> pa.DataType | None:
    """How a column is held that pandas would make an object a value of; None for the others."""
    if isinstance(field.dataType, DecimalType):
        return pa.decimal128(field.dataType.precision, field.dataType.scale)
    return pa.large_string() if isinstance(field.dataType, StringType) else None


class Packed:
    """Frames put together with decimals and texts as Arrow columns, a sixth or less of what they take as objects."""

    def __init__(self, frames: Iterator[pd.DataFrame], types: dict[str, pa.DataType]):
        self.columns, plain = [], []
        held: dict[str, list[pa.Array]] = {c: [] for c in types}
        for frame in frames:
            self.columns = list(frame.columns)
            for c, kind in types.items():
                held[c].append(pa.array(frame[c], kind, from_pandas=True))
            plain.append(frame.drop(columns=list(types)))
        self.plain = pd.concat(plain, ignore_index=True) if plain else pd.DataFrame()
        self.held = {c: pa.chunked_array(held.pop(c), kind).combine_chunks() for c, kind in types.items()}

    def rows(self, at: np.ndarray) -> pd.DataFrame:
        """Some rows, as they came."""
        out = self.plain.iloc[at].reset_index(drop=True)
        for c, values in self.held.items():
            out[c] = pd.Series(values.take(pa.array(at)).to_pylist(), dtype=object)
        return out[self.columns]


#: Rows of a trigger's share of a shard that are judged at a time.
PIECE = 50_000


class FifoProcessor(StatefulProcessor):
    """The remembered keys of a shard as a ring in state: a batch writes only what it adds or drops.

    ``slots`` holds the keys by their place in the ring, ``places`` the other way round, ``ends`` the first place
    in use and the next free one. A batch looks its own keys up one by one, or reads the ring once if it brings more keys
    than a quarter of it; so memory follows the batch, never the ring. A batch is held packed and worked through in pieces, in
    the order of its rows.
    """

    def __init__(self, size: int, key: Sequence[str], seq: str, types: dict[str, pa.DataType] | None = None):
        self.size, self.key, self.seq, self.types = size, list(key), seq, types or {}

    def init(self, handle) -> None:
        self.slots = handle.getMapState("slots", "place long", "k string")
        self.places = handle.getMapState("places", "k string", "place long")
        self.ends = handle.getValueState("ends", "head long, tail long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = Packed(rows, self.types)  # one trigger's share of one shard; bounded by the source's rate limit
        if not batch.columns:
            return
        order = batch.plain[self.seq].sort_values(kind="stable").index.to_numpy()
        for i in range(0, len(order), PIECE):
            yield self._admitted(batch.rows(order[i : i + PIECE]))

    def _admitted(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of a piece, in order, that pass."""
        first, *rest = (pdf[c].astype(str) for c in self.key)
        names = (first.str.cat(rest, sep="\x1f") if rest else first).tolist()
        head, tail = self.ends.get() or (0, 0)
        start, known = tail, self._known(set(names), tail - head)
        added: dict[int, str] = {}
        gone: list[tuple[int, str]] = []
        keep = []
        for k in names:
            keep.append(k not in known)
            if k in known:
                continue
            if tail - head >= self.size:
                for place in range(head, head + min(max(1, self.size // 10), tail - head)):
                    old = added.pop(place) if place >= start else self.slots.getValue((place,))[0]
                    if place < start:
                        gone.append((place, old))
                    known.discard(old)
                    head = place + 1
            added[tail] = k
            known.add(k)
            tail += 1
        for place, k in gone:
            self.slots.removeKey((place,))
            self.places.removeKey((k,))
        for place, k in added.items():
            self.slots.updateValue((place,), (k,))
            self.places.updateValue((k,), (place,))
        self.ends.update((head, tail))
        return pdf[keep]

    def _known(self, names: set[str], held: int) -> set[str]:
        """Those of the names that the ring holds."""
        if len(names) * 4 < held:
            return {k for k in names if self.places.containsKey((k,))}
        return {k for (k,) in self.places.keys()} & names if held else set()

    def close(self) -> None:
        pass


def fifo(
    ticks: DataFrame,
    size: int = DEFAULT_SIZE,
    shards: int = 8,
    by: str = "key",
    key: Sequence[str] = TICK_KEY,
    seq: str = "trade_id",
) -> DataFrame:
    """The count-bounded filter as a stateful stream operator (RocksDB state store).

    Set a rate limit on the source: a trigger's rows of one shard are put in order in memory.
    """
    if size <= 0:
        return ticks
    marked = with_shard(ticks, shards, by, key)
    schema = StructType(ticks.schema.fields + [StructField("shard", IntegerType(), True)])
    # The arrival number orders the rows, so it stays as it is.
    types = {f.name: kind for f in ticks.schema.fields if f.name != seq and (kind := packed_type(f)) is not None}
    return marked.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=FifoProcessor(size, key, seq, types),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )
