"""Packing token pieces into sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so any number of pieces is described by how many there
are of each length: at most ``capacity`` counts, whatever the input. The packing is computed on these
counts, many equal bins in one step, and is a plan: pieces of length L numbered a..b go to sequences
s..s+b-a at offset o. Pieces are numbered inside their length by Spark, in chunks, and look their
place up in the plan.

1. *Reduction* (Martello and Toth). For the longest piece left, the largest partner that fits is
   fixed for good where the pair dominates all other sets with that piece: it fills the sequence, or
   nothing fits, or no two pieces fit beside the longest, or no two of those that fit are longer
   together than the partner (and no three fit). Equal pieces are fixed together.
2. *Best fit* of the rest, longest first, into the fullest open sequence that takes the piece.

Documents longer than the capacity are cut into pieces of full length, the first being the shorter.

Edge cases: a null or empty text is the end id alone; repeated rows are packed one by one; ties go by
(doc_id, piece, digest), nulls first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import numbered
from ticklake.llm.textblocks import blocks
from ticklake.llm.tokens import encoder
from ticklake.session import cut

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, keeps_space: bool, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, keeps_space)
        for batch in batches:
            names = batch.column(0)
            for first, raw, texts in blocks(batch.column(1)):
                ids, edges = tool.encode(raw, texts)
                n = np.diff(edges) + 1
                # all documents of the block with their end ids, as one run
                whole = np.insert(ids, edges[1:], end_id).astype("<u4")
                at = np.concatenate([[0], np.cumsum(n)])
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                short = n - capacity * (many - 1)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                view = memoryview(whole.tobytes())
                low = ((at[doc] + start) * 4).tolist()
                cuts = [view[a : a + 4 * b] for a, b in zip(low, length.tolist())]
                columns = [
                    names.take(pa.array(first + doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(x) for x in cuts], pa.int64()),
                ]
                labels = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([bytes(x) for x in cuts], pa.binary()))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def pieces(
    docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 and, if wanted, the ids (u4, little endian)."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_pieces(tokenizer, keeps_space, end_id, capacity, keep_ids), schema)


class Plan:
    """Places for pieces, as runs (length, first number, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} in sequences of {capacity}")
            self.left[length] = n
        self.given = [0] * (capacity + 1)
        self.runs: list[tuple[int, int, int, int]] = []
        self.sequences = 0
        self._reduce()
        self.reduced = self.sequences
        self._best_fit()

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.given[length], sequence, offset))
        self.given[length] += n
        self.left[length] -= n

    def _fix(self, n: int, lengths: list[int]) -> None:
        offset = 0
        for length in lengths:
            self._put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def _largest(self, limit: int, but: int) -> int:
        """The largest length up to the limit of which a piece is left beside one of length ``but``."""
        for length in range(limit, 0, -1):
            if self.left[length] > (length == but):
                return length
        return 0

    def _smallest(self, n: int, but: int) -> list[int]:
        """The n smallest pieces left beside one of length ``but``."""
        out: list[int] = []
        for length in range(1, self.capacity + 1):
            out += [length] * min(self.left[length] - (length == but), n - len(out))
            if len(out) == n:
                break
        return out

    def _pair_beats(self, partner: int, room: int, but: int) -> bool:
        """Whether no two pieces that fit in the room together are longer than the partner."""
        for a in range(1, room // 2 + 1):
            if self.left[a] <= (a == but):
                continue
            for b in range(room - a, max(a, partner - a + 1) - 1, -1):
                if self.left[b] > (b == but) + (b == a):
                    return False
        return True

    def _reduce(self) -> None:
        for longest in range(self.capacity, 0, -1):
            while self.left[longest]:
                room = self.capacity - longest
                partner = self._largest(room, longest)
                if not partner:
                    self._fix(self.left[longest], [longest])
                    continue
                few = self._smallest(3, longest)
                dominates = (
                    partner == room
                    or sum(few[:2]) > room
                    or len(few) < 2
                    or ((len(few) < 3 or sum(few) > room) and self._pair_beats(partner, room, longest))
                )
                if not dominates:
                    break
                n = self.left[longest] // 2 if partner == longest else min(self.left[longest], self.left[partner])
                self._fix(n, [longest, partner])

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                room = min((r for r, runs in open_.items() if r >= length and runs), default=0)
                if room:
                    first, n = open_[room].pop()
                else:
                    room, first = self.capacity, self.sequences
                    n = -(-self.left[length] // (room // length))
                    self.sequences += n
                each = min(room // length, self.left[length])
                full = min(n, self.left[length] // each)
                for k in range(each):
                    self._put(length, full, first, self.capacity - room + k * length)
                open_.setdefault(room - each * length, []).append((first, full))
                if full < n:
                    # Sequences of this run that get fewer pieces, or none: they are looked at again.
                    open_.setdefault(room, []).append((first + full, n - full))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(length, first number, first sequence, offset), sorted by the first two."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 4)
        return runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3]


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written pieces."""
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # one row per length
    lengths, firsts, sequences, offsets = Plan(counts, capacity).table()
    # Runs are told apart by length first, then by number: one sorted key of two numbers.
    edges = np.searchsorted(lengths, np.arange(capacity + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        wanted, numbers = length.to_numpy(np.int64), number.to_numpy(np.int64)
        run = np.empty(len(wanted), dtype=np.int64)
        for one in np.unique(wanted):
            low, high = edges[one], edges[one + 1]
            here = wanted == one
            run[here] = low + np.searchsorted(firsts[low:high], numbers[here], side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + numbers - firsts[run], "offset": offsets[run]})

    ranked = numbered(cut_pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "_number")
    placed = ranked.withColumn("_place", find("length", "_number")).drop("_number")
    return placed.select("*", "_place.sequence_id", "_place.offset").drop("_place")


def pack(
    docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, text) -> pieces with their sequence_id and offset."""
    return place(cut(pieces(docs, tokenizer, keeps_space, end_id, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens): the ids of each sequence, from pieces packed with ``keep_ids``; at most a capacity each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("tokens"))
