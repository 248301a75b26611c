"""Numpy views of Arrow text columns, shared by the operators of this subpackage.

Nulls count as empty texts.  Nothing here looks at a prefix of a text: a batch is
cut between documents only, so that temporaries stay in proportion to
``SLICE_BYTES`` or to the longest single document, whichever is larger.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of unsigned 64-bit values."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX_1
    x = x ^ (x >> _SHIFT)
    x = x * _MIX_2
    return x ^ (x >> _SHIFT)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_BYTE_POWERS = _Powers(_BASE)
_WORD_POWERS = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 document offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole documents of about ``most`` bytes each."""
    if batch.num_rows == 0:
        return
    _, at = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def rebatched(batches, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Small batches joined and large ones cut, towards ``most`` bytes of text each.

    At the end the worker gives freed memory back, as it stays for later tasks.
    """
    held, size = [], 0
    try:
        for batch in batches:
            for part in slices(batch, column, most):
                n = part.column(column).nbytes
                if held and size + n > most:
                    yield _joined(held)
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield _joined(held)
    finally:
        held = []
        give_back()


def give_back() -> None:
    """Returns freed memory to the system; a worker serves many tasks, beside another one."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and each document's first word number.

    A document's last offset closes its last word.
    """
    solid = np.ones(len(raw) + 1, bool)
    np.not_equal(raw, 32, out=solid[:-1])
    solid[:-1] &= (raw - np.uint8(9)) > 4
    solid[-1] = False
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:]
    stop = solid[:-1] & (~solid[1:] | edge[1:])
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any byte span."""
    up, _ = _BYTE_POWERS.get(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans get equal hashes wherever they stand."""
    _, down = _BYTE_POWERS.get(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of word runs ``words[start:end]``; ``family`` picks one of two independent ones."""
    up, down = _WORD_POWERS[family].get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    source = words if family == 0 else mix64(words + np.uint64(0x632BE59BD9B4E019))
    np.cumsum(source * up[: len(words)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def strings(column) -> list[str]:
    """Python texts of a column, nulls as empty."""
    return [x or "" for x in column.to_pylist()]
