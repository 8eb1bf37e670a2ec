"""Vectorised text primitives over Arrow string batches (NumPy on UTF-8 bytes, whole texts, bounded pieces)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
ROWS = 4096
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


SLOTS = 4096
BYTE = _stream(11, 256)
PLACE = _stream(12, SLOTS) | _U(1)
STEP = _stream(13, 64) | _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ROWS rows, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n, at + ROWS)
        yield at, to
        at = to


def rows(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of bounded size with their bytes and offsets."""
    for batch in batches:
        data, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        for a, b in pieces(offsets, limit):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (maximal run outside space and 0x09-0x0D), and each row's range of words."""
    word = ~SPACE[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


AS_IS = np.arange(256, dtype=np.uint8)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each span after the byte table ``fold``, equal for equal bytes wherever they stand."""
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        s, e = starts[at:to], ends[at:to]
        size = e - s
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64)
        index = place + np.repeat(s - first, size)
        place -= np.repeat(first, size)
        total = np.zeros(len(place) + 1, _U)
        np.cumsum(BYTE[fold[data[index]]] * PLACE[place & (SLOTS - 1)], out=total[1:])
        out[at:to] = mix(total[first + size] - total[first] + size.astype(_U))
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, ranges = spans(data, offsets)
    return hashes(data, starts, ends, fold), ranges


def windows(words: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window inside its row; rows with fewer words have none. Returns hashes and ranges."""
    n = len(words) - k + 1
    size = np.maximum(np.diff(ranges) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(size)])
    if n <= 0:
        return np.zeros(0, _U), out
    h = words[:n] * STEP[0]
    for j in range(1, k):
        h += words[j : j + n] * STEP[j]
    keep = np.arange(int(out[-1]), dtype=np.int64) + np.repeat(ranges[:-1] - out[:-1], size)
    return mix(h[keep]), out


def shingle_sets(words: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each row; a row of fewer words has its whole sequence as its only one."""
    full, was = windows(words, ranges, k)
    m = np.diff(ranges)
    short = (m > 0) & (m < k)
    at = np.concatenate([[0], np.cumsum(np.diff(was) + short)])
    h = np.empty(int(at[-1]), _U)
    h[np.arange(len(full)) + np.repeat(at[:-1] - was[:-1], np.diff(was))] = full
    for d in np.flatnonzero(short):
        w = words[ranges[d] : ranges[d + 1]]
        h[at[d]] = mix(np.array([(w * STEP[32 : 32 + len(w)]).sum(dtype=_U) ^ _U(len(w))], _U))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        h[a:b].sort()
    if not len(h):
        return h, at
    new = np.empty(len(h), bool)
    new[0], new[1:] = True, h[1:] != h[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return h[new], kept[at]


def set_sums(h: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """Order-free digest of each row's set."""
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h ^ _U(salt)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(_U))


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte mask over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
