"""Vectorised text primitives for Arrow batches.

Tasks receive whole texts as Arrow batches; these helpers look at the UTF-8
buffer of a slice of rows at once (numpy, no per-row Python). Null texts are
empty. A slice holds whole rows and about ``SLICE_BYTES`` of text, so the
memory of a task is bounded by that and by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

# word = maximal run of bytes outside space and \x09-\x0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(batches, column: str, max_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of whole rows of bounded text size."""
    limit = max_bytes or SLICE_BYTES
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array; null counts as empty."""
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        width = np.int64
    else:
        if not (pa.types.is_string(arr.type) or pa.types.is_binary(arr.type)):
            arr = arr.cast(pa.string())
        width = np.int32
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, width)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Hasher:
    """Polynomial hashes of arbitrary spans of one buffer in O(1) each."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        powers = np.full(n, _BASE, U)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.inverses = np.full(n, _INVERSE, U)
        self.inverses[0] = 1
        np.cumprod(self.inverses, out=self.inverses)
        powers[:-1] *= data.astype(U) + U(1)
        self.sums = np.zeros(n, U)
        np.cumsum(powers[:-1], out=self.sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` bytes, by start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverses[:n])


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Count of true bytes in each row."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end = solid
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, row_of(starts, off)


def row_of(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, at, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    up = (data >= 65) & (data <= 90)
    return data + (up * 32).astype(np.uint8)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the spans [start, start + length) one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def unique_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their number or summed counts."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


class Counter:
    """Running (key, count) table of a task; merges its parts as they grow."""

    def __init__(self, flush: int = 1 << 22):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.flush = 0, flush

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        part = unique_counts(keys, counts)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > self.flush and len(self.parts) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U), np.zeros(0, np.int64)
        part = unique_counts(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        self.parts = [part]
        self.held = len(part[0])
        self.flush = max(self.flush, 2 * self.held)
        return part


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found) of keys in a sorted table."""
    if len(table) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def byte_grams(data: np.ndarray, off: np.ndarray, order: int, pad: int = 10) -> np.ndarray:
    """For every byte, the ``order`` (8 at most) bytes that end there, packed;
    rows begin after ``order - 1`` bytes ``pad``."""
    n, lead = len(off) - 1, order - 1
    out = np.full(len(data) + lead * n, pad, np.uint8)
    at = np.arange(len(data)) + np.repeat(lead * np.arange(1, n + 1), np.diff(off))
    out[at] = data
    at -= lead
    key = out[at].astype(U)
    for _ in range(lead):
        at += 1
        key <<= U(8)
        key |= out[at]
    return key


def sum_rows(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values in each row."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class HashTable:
    """Values by 64-bit key: sorted key hashes behind an index on their top
    bits, so that a lookup reads one or a few neighbouring places."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        h = mix(keys.astype(U))
        order = np.argsort(h)
        self.hashes = np.append(h[order], U(0))  # one more place to look at
        self.values = [np.ascontiguousarray(v[order]) for v in values]
        bits = min(22, int(len(keys)).bit_length() + 1)
        self.shift = U(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((h >> self.shift).view(np.int64), minlength=1 << bits), out=self.first[1:], dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the values, -1 if absent."""
        h = mix(keys)
        at = self.first[(h >> self.shift).view(np.int64)]
        todo = np.flatnonzero(self.hashes[at] != h)
        if len(todo):
            h = h[todo]
            place, end = at[todo], self.first[(h >> self.shift).view(np.int64) + 1]
            at[todo] = -1
            while len(todo):
                place += 1
                go = place < end
                todo, place, end, h = todo[go], place[go], end[go], h[go]
                hit = self.hashes[place] == h
                at[todo[hit]] = place[hit]
                todo, place, end, h = todo[~hit], place[~hit], end[~hit], h[~hit]
        if len(self.hashes) == 1:
            at[:] = -1
        return at
