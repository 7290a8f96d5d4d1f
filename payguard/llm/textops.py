"""Vectorised text primitives for tasks that receive Arrow batches.

Texts stay in Arrow's UTF-8 buffers: words are byte ranges and 64-bit hashes, so no
Python string is made per word. White space is ASCII (0x20, 0x09-0x0D) and
only A-Z is lower-cased, which makes byte-wise work exact on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LETTERISH = np.zeros(256, dtype=bool)  # ASCII letters and every byte of a non-ASCII character
_LETTERISH[65:91] = _LETTERISH[97:123] = _LETTERISH[128:] = True
TERM = _LETTERISH.copy()  # these and ASCII digits
TERM[48:58] = True

#: Bytes of text handled at a time inside a task.
CHUNK_BYTES = 4 << 20


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective, wraps modulo 2**64)."""
    h = (h ^ (h >> U64(30))) * _M2
    h = (h ^ (h >> U64(27))) * _M3
    return h ^ (h >> U64(31))


class Texts:
    """Byte view of a string column: ``buf`` (uint8, one copy, 8 spare bytes
    at the end) and ``off`` (int64, one more than rows). Null texts are empty."""

    def __init__(self, col: pa.Array):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        n = len(col)
        if n == 0:
            self.off, self.buf = np.zeros(1, np.int64), np.zeros(8, np.uint8)
            return
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
        lo, hi = int(off[0]), int(off[-1])
        self.off = off - lo
        self.buf = np.zeros(hi - lo + 8, np.uint8)
        if hi > lo:
            self.buf[:hi - lo] = np.frombuffer(col.buffers()[2], np.uint8)[lo:hi]

    def __len__(self) -> int:
        return len(self.off) - 1

    @property
    def data(self) -> np.ndarray:
        return self.buf[:len(self.buf) - 8]

    def lower(self) -> "Texts":
        np.take(_LOWER, self.buf, out=self.buf)
        return self

    def runs(self, letters: bool = False, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first run of each row) of maximal runs of non-blank
        bytes (``letters``: of ASCII letters and non-ASCII characters; ``of``: of the bytes in a table)."""
        b = self.data
        if not len(b):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(self.off), np.int64)
        w = (of if of is not None else _LETTERISH if letters else _WORD)[b]
        first = w.copy()
        first[1:] &= ~w[:-1]
        cut = self.off[:-1]
        cut = cut[cut < len(b)]
        first[cut] = w[cut]  # a run never crosses a row
        last = w.copy()
        last[:-1] &= ~w[1:]
        cut = cut[cut > 0] - 1
        last[cut] = w[cut]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hash of each byte range."""
        n = ends - starts
        h = mix64(n.astype(U64) + U64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
        if not len(n):
            return h
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, 0, (1,))
        live, at = None, starts
        left = n
        while True:
            part = eight[at] if len(at) else np.zeros(0, U64)
            short = np.minimum(left, 8).astype(U64)
            mask = np.where(short >= 8, U64(0xFFFFFFFFFFFFFFFF), (U64(1) << (short * U64(8) & U64(63))) - U64(1))
            part &= mask
            if live is None:
                h = mix64(h ^ part * _M1)
                live = np.flatnonzero(left > 8)
            else:
                h[live] = mix64(h[live] ^ part * _M1)
                live = live[left > 8]
            if not len(live):
                return h
            at = at[left > 8] + 8
            left = left[left > 8] - 8


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most ``limit`` bytes of text (a longer
    text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_null(col.type):
        yield batch
        return
    size = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
