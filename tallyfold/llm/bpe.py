"""Byte-level BPE encoding and decoding.

Boundaries are found without a regular expression.  Every code point becomes a
symbol class; every class is a transition function of a small automaton; the
functions' closure under composition is a finite monoid, so the automaton's state
after every code point comes from one associative scan over monoid numbers (a
pair-up and a fill-in pass, each a table look-up over whole arrays).  Token starts
then follow from the state, the class and the next class.  The slices go to pair
merging through a bounded cache of finished pieces.

Nulls and empty texts have no ids.  Texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import rebatched, strings

# Symbol classes.
_L, _STMD, _R, _V, _ELL, _E, _N, _O, _Q, _SP, _WS, _END = range(12)
# Automaton states: what the code points up to here have come to.
_BOS, _IN_L, _IN_N, _IN_O, _IN_SP, _IN_WS, _AT_Q, _AT_QR, _AT_QL, _DONE = range(10)

#: Unicode's White_Space property.
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

CACHE_PIECES = 100_000
LONG_PIECE = 64
_NONE = np.iinfo(np.int32).max


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 2, _O, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = _L
        elif kind == "N":
            out[i] = _N
    out[list(_WHITE)] = _WS
    out[32] = _SP
    out[[ord(c) for c in "stmd"]] = _STMD
    for c, kind in (("r", _R), ("v", _V), ("l", _ELL), ("e", _E), ("'", _Q)):
        out[ord(c)] = kind
    out[sys.maxunicode + 1] = _END  # stands between documents
    return out


def _step(state: int, symbol: int) -> int:
    if symbol == _END:
        return _BOS
    if symbol == _SP:
        return _IN_SP
    if symbol == _WS:
        return _IN_WS
    if symbol == _N:
        return _IN_N
    if symbol == _Q:
        # An apostrophe opens a token unless a run of signs or a joined space stands before it.
        return _IN_O if state in (_IN_O, _IN_SP, _AT_Q) else _AT_Q
    if symbol == _O:
        return _IN_O
    if state == _AT_Q:
        return {_STMD: _DONE, _R: _AT_QR, _V: _AT_QR, _ELL: _AT_QL}.get(symbol, _IN_L)
    if state == _AT_QR and symbol == _E or state == _AT_QL and symbol == _ELL:
        return _DONE
    return _IN_L


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each symbol's function, composition table, state each function takes _BOS to)."""
    known: dict[tuple[int, ...], int] = {}
    order: list[tuple[int, ...]] = []

    def number(f: tuple[int, ...]) -> int:
        if f not in known:
            known[f] = len(order)
            order.append(f)
        return known[f]

    own = [number(tuple(_step(s, c) for s in range(10))) for c in range(12)]
    done = 0
    while done < len(order):
        for g in list(order):
            number(tuple(g[s] for s in order[done]))
            number(tuple(order[done][s] for s in g))
        done += 1
    n = len(order)
    table = np.array([[known[tuple(g[s] for s in f)] for g in order] for f in order], np.uint16)
    return np.array(own, np.uint16), table.ravel(), np.array([f[_BOS] for f in order], np.uint8) if n else None


def _scan(f: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """Inclusive scan of function numbers under composition."""
    if len(f) == 1:
        return f
    even = len(f) // 2 * 2
    pairs = table.take(f[0:even:2].astype(np.int32) * n + f[1:even:2])
    sums = _scan(pairs, table, n)
    out = np.empty_like(f)
    out[0] = f[0]
    out[1::2] = sums
    rest = f[2::2]
    out[2::2] = table.take(sums[: len(rest)].astype(np.int32) * n + rest)
    return out


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes end to end, each piece's start (and one end more), and each text's first piece.

    One separator follows every text and is a piece of its own.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(sizes + 1)
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    points[stops - 1] = sys.maxunicode + 1
    kind = _classes().take(points)
    own, table, end = _monoid()
    state = end.take(_scan(own.take(kind), table, int(round(len(table) ** 0.5))))

    # Coarse class: letters, digits, signs, white space, separator.
    coarse = np.array([0, 0, 0, 0, 0, 0, 1, 2, 2, 3, 3, 4], np.uint8).take(kind)
    before = np.empty_like(coarse)
    before[0], before[1:] = 4, coarse[:-1]
    after = np.empty_like(coarse)
    after[-1], after[:-1] = 4, coarse[1:]
    was = np.empty_like(state)
    was[0], was[1:] = _BOS, state[:-1]
    white = coarse == 3
    start = coarse != before
    # The last of several white points before a visible one stands apart, and a plain space joins what follows.
    start |= white & (before == 3) & (after < 3)
    start &= ~((was == _IN_SP) & (coarse < 3))
    # Contractions: nothing starts inside them, something starts after them.
    done = state == _DONE
    start[done] = False
    two = np.flatnonzero(done & ((was == _AT_QR) | (was == _AT_QL)))
    start[two - 1] = False
    start |= was == _DONE
    start[coarse == 4] = True
    starts = np.flatnonzero(start)
    # Separators are pieces of their own here: text i's pieces stand before the i-th of them.
    marks = np.searchsorted(starts, stops - 1)
    raw = joined.encode()
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return raw, np.append(lead[starts], len(raw)), np.concatenate([[0], marks + 1])


class Codec:
    """Encodes and decodes by a file of ranks, one line ``base64 rank`` for each token.

    ``added`` tokens are cut out of a text before anything else, the longest first.
    """

    def __init__(self, path: str | None = None, ranks: dict[bytes, int] | None = None, added: dict[str, int] | None = None):
        if ranks is None:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.added = {token: i.to_bytes(4, "little") for token, i in (added or {}).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.tokens = [b""] * (max([*self.ranks.values(), *(added or {}).values()]) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        for text, i in (added or {}).items():
            self.tokens[i] = text.encode()
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self._index_pairs()

    def _index_pairs(self) -> None:
        """Open-addressed table of all pairs of tokens whose bytes together are a token."""
        ranks = self.ranks
        pairs = [(a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([r for _, r in pairs], np.int32)
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, _NONE, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            if self.probes > 60:
                raise ValueError("the pair table is too full")
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; ``_NONE`` where the two make no token or one is missing."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        slot = self._slot(keys)
        at = self.keys.take(slot)
        out = np.where(at == keys, self.values.take(slot), _NONE)
        left = np.flatnonzero((at != keys) & (at != -1) & (b >= 0) & (a >= 0))
        for step in range(1, self.probes):
            if not len(left):
                break
            at = self.keys.take(slot[left] + step)
            hit = at == keys[left]
            out[left[hit]] = self.values.take(slot[left[hit]] + step)
            left = left[~hit & (at != -1)]
        return out

    def _merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Pair merging of many pieces side by side, one merge of each at a time."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        low = 0
        for high in (4, 8, 12, 16, 24, 40, LONG_PIECE):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(rows):
                raw = b"".join([pieces[i].ljust(high, b"\0") for i in rows.tolist()])
                ids = self.first.take(np.frombuffer(raw, np.uint8)).reshape(len(rows), high)
                length = sizes[rows]
                ids[np.arange(high) >= length[:, None]] = -1
                scores = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), high - 1)
                # Every row left makes one merge a round, so that the arrays lose a column each time.
                for width in range(high - 1, -1, -1):
                    at = scores.argmin(1) if width else np.zeros(len(rows), np.int64)
                    line = np.arange(len(rows))
                    best = scores[line, at] if width else np.full(len(rows), _NONE, np.int32)
                    go = best != _NONE
                    over = np.flatnonzero(~go)
                    if len(over):
                        flat, n = ids[over].astype("<u4").tobytes(), 4 * (width + 1)
                        for k, (i, m) in enumerate(zip(rows[over].tolist(), (4 * length[over]).tolist())):
                            out[i] = flat[k * n : k * n + m]
                        if len(over) == len(rows):
                            break
                        rows, ids, scores, length, at, best = rows[go], ids[go], scores[go], length[go], at[go], best[go]
                        line = np.arange(len(rows))
                    ids[line, at] = best
                    keep = np.ones(ids.shape, bool)
                    keep[line, at + 1] = False
                    ids = ids[keep].reshape(len(rows), width)
                    length = length - 1
                    keep = np.ones(scores.shape, bool)
                    keep[line, at] = False
                    scores = scores[keep].reshape(len(rows), width - 1)
                    right = np.flatnonzero(at + 1 < width)
                    here = at[right]
                    scores[right, here] = self._pair_ranks(ids[right, here], ids[right, here + 1])
                    left = np.flatnonzero(at > 0)
                    here = at[left]
                    scores[left, here - 1] = self._pair_ranks(ids[left, here - 1], ids[left, here])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges through a heap: n log n for runs of thousands of bytes."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            end[i], end[j] = stop, -1
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return np.array(out, "<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that the young cache lacks."""
        got: dict[bytes, bytes] = {}
        todo = []
        for piece in pieces:
            if (ids := self.old.get(piece)) is not None:
                got[piece] = ids
                continue
            if (whole := self.ranks.get(piece)) is not None:
                got[piece] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                got[piece] = self._merge_long(piece)
            else:
                todo.append(piece)
        for i in range(0, len(todo), 20_000):
            got.update(zip(todo[i : i + 20_000], self._merge_many(todo[i : i + 20_000])))
        if len(self.new) + len(got) > CACHE_PIECES:
            self.old, self.new = self.new, {}
        self.new.update((k, v) for k, v in got.items() if len(k) <= LONG_PIECE)
        return got

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        held = {i: self.cut.split(text) for i, text in enumerate(texts) if any(token in text for token in self.added)}
        if not held:
            return self._encode_ordinary(texts)
        # A split text has ordinary pieces at even places and added tokens at odd ones.
        flat = [piece for i, text in enumerate(texts) for piece in (held[i][::2] if i in held else (text,))]
        ids = iter(self._encode_ordinary(flat))
        return [b"".join(self.added[piece] if k & 1 else next(ids) for k, piece in enumerate(held[i])) if i in held else next(ids) for i in range(len(texts))]

    def _encode_ordinary(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        joined, starts, first = boundaries(texts)
        # Each distinct piece is looked up once; ids are then copied for all places at once.
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(joined)])
        coded = pieces.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        found = list(map(self.new.get, distinct))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            got = self._learn([distinct[i] for i in gaps])
            for i in gaps:
                found[i] = got[distinct[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        n = sizes.take(code)
        marks = first[1:] - 1
        n[marks] = 0  # separators
        ends = np.cumsum(n)
        ids = flat.take(np.repeat(at.take(code) - ends + n, n) + np.arange(ends[-1])).tobytes()
        stops = [0, *(4 * ends[marks]).tolist()]
        return [ids[a:b] for a, b in zip(stops, stops[1:])]

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each token in the decoded bytes, and their length last."""
        sizes = [len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) if sizes else np.zeros(1, np.int64)


@lru_cache(4)
def codec(path: str) -> Codec:
    """One codec for each file and Python worker; its cache lives as long as the worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text; no shuffle, one pass.

    Returns the key with ``ids`` and ``offsets`` (arrays; byte offset of each token),
    or with ``digests`` instead n_tokens, ids_sha256 and decoded_sha256, where the
    decoded bytes come from the ids.  Null and empty texts have no ids.  Repeated
    rows give repeated rows; other columns are not looked at.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, offsets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in rebatched(batches):
            ids = own.encode_batch(strings(part.column("text")))
            if digests:
                cols = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [
                    pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())),
                    pa.array([own.offsets(x) for x in ids], pa.list_(pa.int64())),
                ]
                names = ["ids", "offsets"]
            yield pa.RecordBatch.from_arrays([part.column("key"), *cols], names=[key, *names])

    return rows.mapInArrow(run, f"`{key}` {kind}, {tail}")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Texts' bytes from ``ids``; null ids decode to no bytes."""
    rows = encoded.select(encoded[key].alias("key"), encoded["ids"].alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=[key, "decoded"])

    return rows.mapInArrow(run, f"`{key}` {kind}, decoded binary")
