"""Texts of many rows as one byte block, for vectorised work inside tasks.

A block is the UTF-8 bytes of several texts end to end with their offsets. Blocks
stay small (`BLOCK_BYTES`, or one text if it is longer), so a task's memory does not
follow its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 500_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# The characters \x20 and \x09-\x0D end words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of consecutive slices of a string column; null texts count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = max(n, BLOCK_BYTES + 1)
        known = np.full(size, base, _U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values, so that every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for many spans at once."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * _powers_of(_BASE, len(values)), out=sums[1:])
    shifted = (sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(values) + 1)[starts]
    return mix(shifted + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word; words do not cross rows."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SPACE[data]
    inside = ~gap[1:-1]
    begin = inside & gap[:-2]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    finish = inside & gap[2:]
    finish[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each run of `size` words inside one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    value = np.zeros(len(first), _U)
    for i in range(size):
        value = mix(value * _BASE + hashes[first + i])
    return value, rows[first], first


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each count, end to end; places below 2**31."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((starts - (ends - counts)).astype(np.int32), counts) + np.arange(total, dtype=np.int32)
