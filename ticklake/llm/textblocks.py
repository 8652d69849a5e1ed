"""Texts of an Arrow column as byte blocks, and hashes of spans of them, for numpy.

A block holds whole texts, about a megabyte of them or a single longer one, so that temporary
arrays stay small however long texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_LANE = _U(0x9E3779B97F4A7C15)
#: The bytes that a lane of 0 to 8 bytes keeps.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)

#: 1 for bytes of words, 0 for ASCII white space; ASCII upper case mapped to lower case.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, start of each text and the end) for runs of rows; nulls are empty texts."""
    column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, raw[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def lanes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one number, zeros behind the end of the span."""
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(raw) + 1,), strides=(1,))
    keep = np.clip(lengths, 0, 8)
    return eights[np.minimum(starts, len(raw))] & _KEEP[keep]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; the same bytes give the same hash wherever they stand.

    Lanes of eight bytes are mixed with their number in the span before they are added up, so that no pattern
    of the bytes cancels out. Two different spans meet with probability about 2^-64 unless they were made by
    inverting the mixer: whoever needs certainty compares bytes.
    """
    length = ends - starts
    value = mix64(lanes(raw, starts, length) + _LANE)
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8  # lanes after the first
        edges = np.cumsum(more) - more
        number = np.arange(int(more.sum())) - np.repeat(edges, more) + 1
        at = np.repeat(starts[long], more) + 8 * number
        part = lanes(raw, at, np.repeat(ends[long], more) - at)
        mixed = mix64(mix64(part + _LANE) + (number + 1).astype(_U) * _LANE)
        value[long] += np.add.reduceat(mixed, edges)
    return mix64(value + length.astype(_U) * _U(0xD6E8FEB86659FD93))


def words_of_texts(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts of a block; a word ends where its text ends."""
    inside = IS_WORD[raw].view(np.int8)
    n = len(inside)
    begins, ends = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    if n:
        begins[0], ends[-1] = inside[0] == 1, inside[-1] == 1
        begins[1:] = inside[1:] > inside[:-1]
        ends[:-1] = inside[:-1] > inside[1:]
        cut = starts[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut] == 1
        ends[cut - 1] = inside[cut - 1] == 1
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1
