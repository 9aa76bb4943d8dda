"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

A chunk of documents is one byte array with document bounds; words, n-grams
and their hashes come from array operations over it, not from a Python loop
per word.  Hashes are differences of a polynomial prefix sum modulo 2**64,
brought to a common origin by the inverse powers and then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}
CHUNK_BYTES = 1 << 19


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks and share an executor's limit."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _powers(n: int, base: int) -> np.ndarray:
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            k = min(done, size - done)
            np.multiply(have[:k], np.uint64(pow(base, done, 1 << 64)), out=have[done:done + k])
            done += k
        if size <= 4 * CHUNK_BYTES:
            _TABLES[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte spans ``[start, end)``; equal bytes hash alike."""
    return mix((sums[end] - sums[start]) * _powers(len(sums), _INVERSE)[start])


def gram_hashes(data: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Mixed hash of the ``k`` bytes at every position that has ``k`` bytes after it."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data) if sums is None else sums
    return mix((sums[k:] - sums[:-k]) * _powers(n, _INVERSE))


def slices(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``limit``; a row is never cut."""
    group = (np.cumsum(size, dtype=np.int64) - size) // limit
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(size)]))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each; a text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for a, b in slices(size, limit):
            yield batch.slice(a, b - a)
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the bounds of its values (null: empty)."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that stay within one document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | first))
    last = np.zeros(n, bool)
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    after = np.concatenate((inside[1:], [False]))
    return start, np.flatnonzero(inside & (~after | last)) + 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+`` of each document."""
    return runs(~_SPACE[data], bounds)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data | 0x20, data)
