"""Words and hashes of Arrow string columns as numpy arrays, a few MB of text at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def spread(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return off - off[0], data


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """The batch in runs of rows with at most limit bytes of text, or one row each."""
    if not batch.num_rows:
        return
    off, _ = buffers(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a string column, A-Z lower-cased.

    data, off: bytes and row offsets; start, end, doc: place and row of each word; first: index
    of each row's first word, with one more entry at the end.
    """

    def __init__(self, col: pa.Array, lower: bool = True):
        self.off, data = buffers(col)
        up = np.arange(256, dtype=np.uint8)
        if lower:
            up[65:91] += 32
        self.data = data = up[data]
        n = len(data)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        word = ~space
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        before[self.off[:-1][self.off[:-1] < n]] = True
        after[(self.off[1:] - 1)[self.off[1:] > 0]] = True
        self.start, self.end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        table = spread(256, 7)
        p = np.uint64(0x9E3779B97F4A7C15 | 1)
        inv = np.uint64(pow(int(p), -1, 1 << 64))
        n = len(self.data) + 1
        up, down = np.full(n, p), np.full(n, inv)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.zeros(n, np.uint64)
        np.cumsum(table[self.data] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive items within one row, and the index of the first item."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = spread(k, 11)
    s = np.zeros(m, np.uint64)
    for j in range(k):
        s += h[j : j + m] * c[j]
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    return mix(s[at]), at


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: consecutive pieces of the items of data, piece i ending before item ends[i]."""
    off = np.zeros(len(ends) + 1, np.int64)
    off[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((off * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
