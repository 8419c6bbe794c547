"""Vectorised helpers over Arrow text columns: whole batches as one byte buffer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, LONG = 1 << 20, 1024
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the offsets where each begins, one more than texts."""
    col = as_array(col)
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = buf[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def row_slices(offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def same_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of one size that begin at a and at b hold the same bytes."""
    eight = SpanHash(buf).eight
    out = np.ones(len(a), bool)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = bool((buf[a[i] : a[i] + size[i]] == buf[b[i] : b[i] + size[i]]).all())
    live = np.flatnonzero((size > 0) & (size <= LONG) & (a != b))
    x, y, left = a[live], b[live], size[live]
    while len(live):
        mask = _MASKS[np.minimum(left, 8)]
        equal = (eight[x] & mask) == (eight[y] & mask)
        out[live[~equal]] = False
        more = np.flatnonzero(equal & (left > 8))
        live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
    return out


class SpanHash:
    """64-bit hashes of any spans of a byte buffer, from their bytes in steps of eight.

    Each step mixes eight bytes into the whole state, so no arrangement of letters
    makes two spans equal, as sums of powers would.  Spans over LONG bytes get a
    cryptographic digest.
    """

    def __init__(self, buf: np.ndarray):
        self.data = np.zeros(len(buf) + 8, np.uint8)
        self.data[: len(buf)] = buf
        self.eight = np.ndarray((len(buf) + 1,), np.uint64, self.data.data, 0, (1,))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        left = end - start
        h = mix(left.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9E3779B97F4A7C15))
        long = np.flatnonzero(left > LONG)
        for i in long.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
        live = np.flatnonzero((left > 0) & (left <= LONG))
        at, left = start[live], left[live]
        while len(live):
            h[live] = mix(h[live] * np.uint64(0xD1B54A32D192ED03) ^ (self.eight[at] & _MASKS[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h
