"""Array helpers for tasks: Arrow text columns as numpy arrays, words and their hashes.

A word is a run of bytes other than space and 0x09-0x0D.  Everything here works
on one Arrow batch at a time, cut into chunks of about half a megabyte, so memory
does not depend on the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers[base]
    if len(table) < length:
        table = np.full(max(length, 2 * len(table)), base, np.uint64)
        table[0] = 1
        table = _powers[base] = np.cumprod(table, dtype=np.uint64)
    return table[:length]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over all bits (a bijection)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a chunk of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, and per row the offset of its first word.

    ``offsets`` may be a slice; equal words have equal hashes in every call.
    """
    base = int(offsets[0])
    data = raw[base : int(offsets[-1])]
    rows = offsets - base
    size = len(data)
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    inside = ~_SPACE[data]
    starts_row = np.zeros(size + 1, dtype=bool)
    starts_row[rows] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | starts_row[1:-1]
    first = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts_row[1:-1]
    last = np.flatnonzero(ends)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, size), out=sums[1:])
    hashes = (sums[last + 1] - sums[first]) * _power_table(_BASE_INVERSE, size)[first]
    return mix(hashes), np.searchsorted(first, rows).astype(np.int64)


def shingle_hashes(
    words: np.ndarray, first: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words within each row, and the row offsets.

    A row of fewer words, but one at least, has a single shingle of all of them.
    """
    counts = np.diff(first)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(shingles))).astype(np.int64)
    total = int(offsets[-1])
    if total == 0:
        return np.zeros(0, np.uint64), offsets
    row = np.repeat(np.arange(len(counts)), shingles)
    at = np.arange(total) - offsets[row] + first[row]
    end = first[row + 1]
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    value = np.zeros(total, np.uint64)
    for k in range(width):
        part = np.where(at + k < end, padded[at + k], np.uint64(0))
        value = (value + part) * np.uint64((_BASE + 2 * k * 0x632BE59BD9B4E019) & _MASK | 1)
        value ^= value >> np.uint64(29)
    return mix(value), offsets


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values; empty rows sum to 0.  Wraps for unsigned values."""
    sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return sums[first[1:]] - sums[first[:-1]]
