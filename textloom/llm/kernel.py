"""Vectorised word kernels over Arrow string buffers (numpy only, no per-word Python).

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  Words are named by a
64-bit polynomial fingerprint of their bytes, so equal words have equal names in every task
without a shared dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 & ~7 | 3  # = 3 mod 8, so powers of it stay far apart modulo 2**64
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text handled at once; a kernel needs about 40 times as much memory.
CHUNK_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first n powers and their inverses modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, pow(_MULT, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * U(pow(base, have, 1 << 64))
                have *= 2
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def strings(column: pa.Array) -> pa.Array:
    """The column as a string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and the offsets of each, from 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str | int = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about size bytes of text; a longer text is a slice of its own."""
    _, offsets = raw(strings(batch.column(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def grouped(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """The rows of one group after the other; the input is sorted by these integer columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in columns], axis=1)
        cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))), len(keys))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = tuple(keys[a])
            if key is not None and mine != key:
                yield pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Words(NamedTuple):
    data: np.ndarray  #: bytes of all texts, lower-cased if asked for
    first: np.ndarray  #: where each word starts in data
    end: np.ndarray
    row: np.ndarray  #: the row of each word
    name: np.ndarray  #: the fingerprint of each word
    bounds: np.ndarray  #: row r has the words bounds[r] to bounds[r + 1]


def words(column: pa.Array, lower: bool = False, names: bool = True) -> Words:
    """All words of a string column."""
    data, offsets = raw(strings(column))
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    first, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    bounds = np.searchsorted(first, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    name = np.zeros(len(first), np.uint64)
    if names and len(first):
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
        name = mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
    return Words(data, first, end, row, name, bounds)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of k words within a row, and the index of each run's first word."""
    n = len(w.name) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    name = w.name[at]
    for j in range(1, k):
        name = mix(name * U(0xD6E8FEB86659FD93) + w.name[at + j])
    return name, at


def sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct runs of k words as sorted names, and bounds by row.

    A row with words but fewer than k has its whole sequence as its only run; a row without words none.
    """
    name, at = grams(w, k)
    row = w.row[at]
    count = np.diff(w.bounds)
    if len(short := np.flatnonzero((count > 0) & (count < k))):
        extra = np.full(len(short), 0x51ED270B, np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] = mix(extra[has] * U(0xD6E8FEB86659FD93) + w.name[w.bounds[short[has]] + j])
        name, row = np.concatenate([name, extra]), np.concatenate([row, short])
    order = np.lexsort((name, row))
    name, row = name[order], row[order]
    if len(name):
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        name, row = name[new], row[new]
    return name, np.searchsorted(row, np.arange(len(count) + 1))


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds, as an array of lists of signed 64-bit integers."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
