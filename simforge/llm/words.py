"""Words of whole Arrow string columns as numpy arrays.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r, which
on UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``.  Everything works on the column's
byte buffer, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; a longer document is handled alone.
SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTES, _OTHER_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


#: Powers up to this many are kept from one slice to the next.
KEPT_POWERS = 1 << 21
_KEPT: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; not to be written to."""
    if n > KEPT_POWERS:
        return _powers(base, n)
    if base not in _KEPT or n > len(_KEPT[base]):
        _KEPT[base] = _powers(base, -(-max(n, 1) // (1 << 18)) << 18)
    return _KEPT[base][:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``second`` is another one, independent of the first."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    step, table = (_GRAM, _OTHER_BYTES) if second else (_STEP, _BYTES)
    total = np.r_[np.uint64(0), np.cumsum(table[data] * powers(step, n), dtype=np.uint64)]
    got = (total[end] - total[start]) * powers(pow(step, -1, 1 << 64), n + 1)[start]
    return mix(got ^ (end - start).astype(np.uint64) * np.uint64(_GRAM))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text each (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """Words of a string column: ``start``/``end`` into ``data`` and the row ``doc`` of each word."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.at = text_bytes(column)
        self.data = LOWER[data] if lower else data
        inside = np.r_[~SPACE[self.data], False]
        before = np.r_[False, inside[:-1]]
        edge = np.zeros(len(inside), bool)
        edge[self.at] = True
        begins = inside & (edge | ~before)
        ends = before & (edge | ~inside)
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.n = np.diff(np.searchsorted(self.start, self.at))
        self.first = np.cumsum(np.r_[0, self.n])[:-1]
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of each run of k words that lies in one row."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up = powers(_GRAM, n + 1)
        total = np.r_[np.uint64(0), np.cumsum(hashes * up[:n], dtype=np.uint64)]
        down = powers(pow(_GRAM, -1, 1 << 64), n + 1)
        got = mix((total[k:] - total[:-k]) * down[: n - k + 1])
        own = np.flatnonzero(self.doc[k - 1 :] == self.doc[: n - k + 1])
        return own, got[own]

    def joined(self, keep: np.ndarray, row: int) -> bytes:
        """The kept words of one row, joined by one space."""
        a, b = self.first[row], self.first[row] + self.n[row]
        s, e = self.start[a:b][keep], self.end[a:b][keep]
        if not len(s):
            return b""
        # each word with the byte after it; that byte becomes the joining space
        size = e - s + 1
        out_at = np.cumsum(size) - size
        index = np.repeat(s - out_at, size) + np.arange(size.sum())
        out = self.data[np.minimum(index, len(self.data) - 1)]
        out[out_at + size - 1] = 32
        return out[:-1].tobytes()
