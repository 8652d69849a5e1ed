"""Token ids as files of directly addressable codes.

Ids are cut into chunks of 8, 8 and 16 bits, lowest first. The first level holds the lowest chunk of
every id, a bitmap beside it says which ids go on, and the next level holds the next chunk of just
those. A rank directory over each bitmap (set bits before every 512) tells where an id goes on, so any
id is read with one look-up per level, and nothing before it is decoded.

The files: Parquet rows of one *segment* each, in ascending doc_id order over all parts, one part per
task. A segment holds whole documents, about ``SEGMENT_TOKENS`` ids, with its documents' ids and
lengths, its start in the part, and the codes as one binary value (``encode`` describes its layout).
``parts`` beside them holds each part's first id number. Spark's commit protocol makes a lost task's
part appear once.

``tokens_at`` reads ids by their number over all files: positions find their segment by an equi-join on ranges of
ids, and each id is read from its segment's codes alone.

Edge cases: a null or empty text is the end id alone; null doc_ids come first; rows with the same
doc_id stand by text; an empty table gives a table without segments; further columns are ignored; positions outside the files give no row. A
text of any length is one document in one segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklake.llm.textblocks import blocks
from ticklake.llm.tokens import encoder
from ticklake.session import cut

SEGMENT_TOKENS = 1 << 18
WIDTHS = (8, 8, 16)
RANK_BITS = 512
MAGIC = b"DAC1"
SCHEMA = "part int, segment int, start long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, codes binary"
READ = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray, widths: Sequence[int] = WIDTHS) -> bytes:
    """The codes of a run of ids.

    Layout, little endian: magic, number of levels (u4), widths (u4 each), ids per level (u8 each);
    then per level its chunks (whole bytes each) and, but for the last, its bitmap (bit i in byte
    i // 8 at i % 8, padded to whole directory blocks) and its rank directory (u8 per 512 bits).
    """
    rest = ids.astype(np.uint64)
    counts, parts = [], []
    for k, width in enumerate(widths):
        counts.append(len(rest))
        parts.append((rest & np.uint64((1 << width) - 1)).astype(f"<u{width // 8}").tobytes())
        if k + 1 < len(widths):
            rest >>= np.uint64(width)
            goes_on = rest > 0
            padded = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS, dtype=bool)
            padded[: len(rest)] = goes_on
            parts.append(np.packbits(padded, bitorder="little").tobytes())
            sums = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64)
            parts.append((np.cumsum(sums) - sums).astype("<u8").tobytes())
            rest = rest[goes_on]
        elif len(rest) and int(rest.max()) >> width:
            raise ValueError("an id needs more bits than the levels have")
    head = np.array([len(widths), *widths], dtype="<u4").tobytes() + np.array(counts, dtype="<u8").tobytes()
    return b"".join([MAGIC, head, *parts])


class Codes:
    """Reads ids out of the codes of a segment, at any place."""

    def __init__(self, raw: bytes):
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a run of directly addressable codes")
        levels = int(np.frombuffer(raw, "<u4", 1, 4)[0])
        self.widths = np.frombuffer(raw, "<u4", levels, 8).tolist()
        counts = np.frombuffer(raw, "<u8", levels, 8 + 4 * levels).astype(np.int64).tolist()
        at = 8 + 12 * levels
        self.chunks, self.bitmaps, self.ranks = [], [], []
        for k, (width, n) in enumerate(zip(self.widths, counts)):
            self.chunks.append(np.frombuffer(raw, f"<u{width // 8}", n, at))
            at += n * width // 8
            if k + 1 < levels:
                held = -(-n // RANK_BITS)
                self.bitmaps.append(np.frombuffer(raw, np.uint8, held * RANK_BITS // 8, at))
                at += held * RANK_BITS // 8
                self.ranks.append(np.frombuffer(raw, "<u8", held, at))
                at += held * 8

    def __len__(self) -> int:
        return len(self.chunks[0])

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        block, inside = divmod(i, RANK_BITS)
        if block == len(self.ranks[level]):
            return len(self.chunks[level + 1])
        first = block * RANK_BITS // 8
        bits = np.unpackbits(self.bitmaps[level][first : first + RANK_BITS // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[:inside].sum())

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for level, width in enumerate(self.widths):
            value |= int(self.chunks[level][i]) << shift
            if level + 1 == len(self.widths) or not self.bitmaps[level][i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + width
        return value

    def slice(self, low: int, high: int) -> np.ndarray:
        """Ids from low up to high."""
        spans = []
        for level in range(len(self.widths)):
            spans.append((low, high))
            if level + 1 < len(self.widths):
                low, high = self._rank(level, low), self._rank(level, high)
        value = None
        for level in reversed(range(len(self.widths))):
            low, high = spans[level]
            here = self.chunks[level][low:high].astype(np.uint64)
            if value is not None and len(value):
                byte = low // 8
                bits = np.unpackbits(self.bitmaps[level][byte : -(-high // 8)], bitorder="little")
                on = bits[low - byte * 8 : high - byte * 8].astype(bool)
                here[on] |= value << np.uint64(self.widths[level])
            value = here
        return value.astype(np.uint32)


def _segments(path: str, keeps_space: bool, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tool = TaskContext.get().partitionId(), encoder(path, keeps_space)
        number = start = held = 0
        doc_ids: list = []
        lengths: list[int] = []
        runs: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            codes = encode(np.concatenate(runs))
            row = [[part], [number], [start], [held], [doc_ids], [lengths], [codes]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "segment", "start", "n_tokens", "doc_ids", "doc_tokens", "codes"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, raw, texts in blocks(batch.column(1)):
                ids, edges = tool.encode(raw, texts)
                for i in range(len(edges) - 1):
                    runs += [ids[edges[i] : edges[i + 1]], end]
                    doc_ids.append(names[first + i])
                    lengths.append(int(edges[i + 1] - edges[i]) + 1)
                    held += lengths[-1]
                    if held >= segment_tokens:
                        yield segment()
                        number, start, held, doc_ids, lengths, runs = number + 1, start + held, 0, [], [], []
        if doc_ids:
            yield segment()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool, end_id: int, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode the texts of (doc_id, text) and write them under ``path`` in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(_segments(tokenizer, keeps_space, end_id, segment_tokens), SCHEMA)
    made.write.option("compression", "none").parquet(f"{path}/segments")
    spark = docs.sparkSession
    # One row per part: a part is a task's output, so there are as many as the shuffle has partitions.
    totals = spark.read.schema(SCHEMA).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start`` counted over all parts."""
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    held = spark.read.schema(SCHEMA).parquet(f"{path}/segments")
    return held.join(parts, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, at = Codes(row["codes"]), 0
            starts, crcs = [], []
            for n in row["doc_tokens"]:
                starts.append(row["start"] + at)
                crcs.append(zlib.crc32(codes.slice(at, at + n).astype("<u4").tobytes()))
                at += n
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(row["doc_tokens"], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, read back from the codes."""
    return segments(spark, path).mapInArrow(_documents, READ).drop("part")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes = Codes(row["codes"])
            places = sorted(row["positions"])
            ids = [codes[p - row["base"]] for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(ids, pa.int64())], ["position", "id"])


#: Segments that are named one by one in the scan of the codes.
NAMED = 500


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position) -> (position, id): the ids at some numbers, counted from 0 over all files. Repeats count once."""
    held = segments(spark, path).select("part", "segment", "start", "n_tokens")
    first = F.expr(f"start DIV {SEGMENT_TOKENS}")
    last = F.expr(f"(start + n_tokens - 1) DIV {SEGMENT_TOKENS}")
    ranges = held.withColumn("range", F.explode(F.sequence(first, last)))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    asked = asked.withColumn("range", F.expr(f"position DIV {SEGMENT_TOKENS}"))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    found = asked.join(ranges, "range").where(inside)
    # A segment's positions are different ids of it, so a list is never longer than the segment.
    by_segment = found.groupBy("part", "segment", F.col("start").alias("base")).agg(F.collect_list("position").alias("positions"))
    by_segment = cut(by_segment, "asked")
    codes = spark.read.schema(SCHEMA).parquet(f"{path}/segments").select("part", "segment", "codes")
    named = by_segment.select("part", "segment").limit(NAMED + 1).collect()
    if len(named) <= NAMED:
        # Filters that reach the scan: pages of other segments are not read.
        codes = codes.where(F.col("part").isin([r["part"] for r in named]) & F.col("segment").isin([r["segment"] for r in named]))
    met = by_segment.join(codes, ["part", "segment"]).select("base", "positions", "codes")
    return met.mapInArrow(_tokens, "position long, id long")
