"""Elias-Fano sequences and an n-gram trie level made of them, as flat buffers.

A buffer is usable where it lies: ``numpy`` arrays are views of it, whether it came in
an Arrow column or is a memory-mapped file (``mapped``).
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from functools import cached_property

import numpy as np

_HEAD = struct.Struct("<QQQ")


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary."""

    def __init__(self, buffer):
        self.size, self.low_bits, words = _HEAD.unpack_from(buffer)
        self.low = np.frombuffer(buffer, "<u8", words, _HEAD.size)
        self.high = np.frombuffer(buffer, np.uint8, -1, _HEAD.size + 8 * words)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        words = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if n and bits:
            low = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            shift = (at & 63).astype(np.uint64)
            word = at >> 6
            edge = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[edge]] |= np.bitwise_or.reduceat(low << shift, edge)
            over = (low >> np.uint64(1)) >> (np.uint64(63) - shift)
            words[word[edge] + 1] |= np.bitwise_or.reduceat(over, edge)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(high[-1]) if n else 0) + 1, np.uint8)
        unary[high] = 1
        return _HEAD.pack(n, bits, len(words)) + words.astype("<u8").tobytes() + np.packbits(unary, bitorder="little").tobytes()

    @cached_property
    def highs(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.size] - np.arange(self.size)

    def lows(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        at = index * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift | (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, index: np.ndarray) -> np.ndarray:
        return self.highs[index].astype(np.uint64) << np.uint64(self.low_bits) | self.lows(index)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, -1 where it isn't there: successor search within its high bits' run."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        return self.find_within(wanted, np.searchsorted(self.highs, high, "left"), np.searchsorted(self.highs, high, "right"))

    def find_within(self, wanted: np.ndarray, a: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Index of each wanted value between ``a`` and ``stop``, -1 where it isn't there."""
        a, b = a.copy(), stop.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            less = self.get(middle) < wanted[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        out = np.full(len(wanted), -1, np.int64)
        some = np.flatnonzero(a < stop)
        same = self.get(a[some]) == wanted[some]
        out[some[same]] = a[some[same]]
        return out


def quantised(counts: np.ndarray) -> np.ndarray:
    """Codes of counts: exact below 64, then eight steps an octave."""
    counts = np.asarray(counts, np.float64)
    coarse = np.minimum(255, 64 + np.floor(8 * (np.log2(np.maximum(counts, 64)) - 6)))
    return np.where(counts < 64, counts, coarse).astype(np.uint8)


#: What each code stands for: the count itself, or the middle of its step.
COUNTS = np.where(np.arange(256) < 64, np.arange(256), 2.0 ** (6 + (np.arange(256) - 64 + 0.5) / 8))

SUCCESSOR_BITS = 28


class TrieLevel:
    """n-grams of one order: contexts, monotone pointers to their successors, successors, codes.

    A successor is stored relative to its context: its 28-bit mark plus the context's
    rank times 2**28, so that the whole level is one increasing sequence and a search
    is confined to the context's range.
    """

    def __init__(self, buffer):
        sizes = struct.unpack_from("<4Q", buffer)
        at, parts = 32, []
        for n in sizes:
            parts.append(memoryview(buffer)[at : at + n])
            at += n
        self.contexts, self.pointers, self.successors = (EliasFano(p) for p in parts[:3])
        self.codes = np.frombuffer(parts[3], np.uint8)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
        """From increasing keys (context mark, then 28 bits of successor mark) and their counts."""
        keys = np.asarray(keys, np.uint64)
        context = keys >> np.uint64(SUCCESSOR_BITS)
        first = np.flatnonzero(np.diff(context, prepend=context[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))).astype(np.uint64)
        successor = rank << np.uint64(SUCCESSOR_BITS) | keys & np.uint64((1 << SUCCESSOR_BITS) - 1)
        parts = [EliasFano.encode(context[first]), EliasFano.encode(np.append(first, len(keys))), EliasFano.encode(successor), quantised(counts).tobytes()]
        return struct.pack("<4Q", *map(len, parts)) + b"".join(parts)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, 0 where the n-gram isn't there."""
        keys = np.asarray(keys, np.uint64)
        out = np.zeros(len(keys), np.uint8)
        if not len(self.codes) or not len(keys):
            return out
        rank = self.contexts.find(keys >> np.uint64(SUCCESSOR_BITS))
        some = np.flatnonzero(rank >= 0)
        wanted = rank[some].astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | keys[some] & np.uint64((1 << SUCCESSOR_BITS) - 1)
        # The context's pointers confine the search to its own successors.
        place = self.successors.find_within(wanted, self.pointers.get(rank[some]).astype(np.int64), self.pointers.get(rank[some] + 1).astype(np.int64))
        hit = place >= 0
        out[some[hit]] = self.codes[place[hit]]
        return out

    def range_of(self, context: int) -> tuple[int, int]:
        """Where a context's successors lie; an empty range if it has none."""
        rank = int(self.contexts.find(np.array([context], np.uint64))[0])
        if rank < 0:
            return 0, 0
        a, b = self.pointers.get(np.array([rank, rank + 1])).tolist()
        return a, b


def scratch(buffer: bytes) -> TrieLevel:
    """A level in a file of the task's own scratch space, memory-mapped; the file goes with the level."""
    with tempfile.TemporaryFile() as file:
        file.write(buffer)
        file.flush()
        return TrieLevel(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


def mapped(path: str) -> TrieLevel:
    """A level of a file, memory-mapped."""
    with open(path, "rb") as file:
        return TrieLevel(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
