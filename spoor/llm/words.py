"""Words of whole text columns as arrays: their places and 64-bit hashes, without an object for each word.

A column's UTF-8 bytes are read where Arrow holds them.  Words are runs of bytes that are not
ASCII white space, and never reach over the end of a row.  A word's hash is a polynomial in an
odd base over random 64-bit values of its bytes, so the hashes of all words of a segment come
from one running sum; where a word stands does not matter, and two different words share a
hash with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once, and bytes of one running sum.
BLOCK, SEGMENT = 1 << 20, 1 << 15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20)
_VALUE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _UNDO = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``size`` bytes; a null row has none."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + column.offset + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) the number of its first word."""
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin, end = solid & cut[:-1], solid & cut[1:]
    begin[1:] |= solid[1:] & ~solid[:-1]
    end[:-1] |= solid[:-1] & ~solid[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes between each start and end; both ascend and ranges do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + SEGMENT, "right"))
        if j <= i:  # longer than a segment
            out[i] = xxhash.xxh64_intdigest(data[a : ends[i]].tobytes())
            i += 1
            continue
        n = int(ends[j - 1]) - a
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data[a : a + n]] * _POWER[:n], out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[ends[i:j] - a] - total[s]) * _UNDO[s]
        i = j
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def text_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The rows between ``offsets`` of UTF-8 bytes as a string column."""
    wide = int(offsets[-1]) >= 1 << 31
    kind, number = (pa.large_string(), np.int64) if wide else (pa.string(), np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(number)), pa.py_buffer(np.ascontiguousarray(data))])
