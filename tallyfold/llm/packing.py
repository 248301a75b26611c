"""Hierarchical multi-length packing of tokenized documents.

Each document, with an end id, is routed to a context-size tier by its length (what
is longer than the longest tier first gives whole windows).  Tiers are packed from
long to short: a tier's document opens a window, gaps in it are filled with the
largest shorter pieces that fit, and what is still open is closed by cutting one
piece.  Windows of a round are dealt to step groups of about equal token counts.

Packing works within each input partition, in rounds of bounded size; what a round
cannot fill is carried to the next.  A partition's last tokens become windows of
powers of two, so that no window needs padding.  Nothing is shuffled; with
the same partitions, a task run again gives the same rows.

Texts are cut at the vocabulary file's added tokens first, and each gives its one id.
Null and empty texts are the end id alone.  Rows with the same key are packed each.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrays import rebatched, strings
from .bpe import Codec

TIERS = (256, 512, 1024, 2048)
END_ID = 1
ROUND_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def json_codec(path: str) -> Codec:
    """A codec from a byte-level BPE file whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, added = whole["model"], whole.get("added_tokens") or []
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        raise ValueError(f"added tokens of {path} take their neighbours into account")
    letters = _byte_letters()
    special = {x for x in model["vocab"] if any(c not in letters for c in x)}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [model["vocab"]["".join(m.split(" "))] for m in merged]
    if any(a >= b for a, b in zip(order, order[1:])):
        raise ValueError(f"ids in {path} do not follow its merges")
    made = {"".join(m.split(" ")) for m in merged}
    ranks = {bytes(letters[c] for c in x): i for x, i in model["vocab"].items() if x not in special and (len(x) == 1 or x in made)}
    return Codec(ranks=ranks, added={x["content"]: x["id"] for x in added})


class _Packer:
    """One partition's windows.  A piece is (document number, start, length)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.stock: list[list[tuple[int, int]]] = [[] for _ in range(tiers[-1] + 1)]
        self.mask = 0  # bit n: there is a piece of n tokens
        self.tokens = 0
        self.windows: list[list[tuple[int, int, int]]] = []

    def add(self, doc: int, n: int) -> None:
        start, top = 0, self.tiers[-1]
        while n - start >= top:
            self.windows.append([(doc, start, top)])
            start += top
        if start < n:
            self._put(doc, start, n - start)

    def _put(self, doc: int, start: int, n: int) -> None:
        self.stock[n].append((doc, start))
        self.mask |= 1 << n
        self.tokens += n

    def _take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        n = (self.mask & ((2 << most) - 1)).bit_length() - 1
        if n < 1:
            return None
        doc, start = self.stock[n].pop()
        if not self.stock[n]:
            self.mask &= ~(1 << n)
        self.tokens -= n
        return doc, start, n

    def _cut(self, gap: int) -> tuple[int, int, int] | None:
        """``gap`` tokens from the start of the shortest longer piece."""
        above = self.mask >> (gap + 1)
        if not above:
            return None
        n = gap + (above & -above).bit_length()
        doc, start = self.stock[n].pop()
        if not self.stock[n]:
            self.mask &= ~(1 << n)
        self.tokens -= n
        self._put(doc, start + gap, n - gap)
        return doc, start, gap

    def pack(self, last: bool) -> None:
        """Fills windows, long tiers first; before the last round a window that can't be filled goes back."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[k]
            below = self.tiers[k - 1] if k else 0
            while (self.mask & ((2 << size) - 1)) >> (below + 1):
                window, gap = [], size
                while gap and (piece := self._take(gap)):
                    window.append(piece)
                    gap -= piece[2]
                if gap and (piece := self._cut(gap)):
                    window.append(piece)
                    gap = 0
                if gap and last:
                    self._powers(window)
                elif gap:
                    for piece in window:
                        self._put(*piece)
                    return
                else:
                    self.windows.append(window)

    def _powers(self, pieces: list[tuple[int, int, int]]) -> None:
        """Windows of powers of two from pieces that fill none."""
        left = sum(n for _, _, n in pieces)
        pieces = pieces[::-1]
        while left:
            gap = 1 << (left.bit_length() - 1)
            left -= gap
            window = []
            while gap:
                doc, start, n = pieces.pop()
                window.append((doc, start, min(n, gap)))
                if n > gap:
                    pieces.append((doc, start + gap, n - gap))
                gap -= min(n, gap)
            self.windows.append(window)

    def steps(self) -> list[int]:
        """A step group for each window: the longest first, to the group with fewest tokens."""
        sizes = [sum(n for _, _, n in w) for w in self.windows]
        groups = max(1, round(sum(sizes) / self.step_tokens))
        heap = [(0, g) for g in range(groups)]
        heapify(heap)
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            n, g = heap[0]
            out[i] = g
            heapreplace(heap, (n + sizes[i], g))
        return out


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document in a window.

    Returns the key, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, step_group and, ``with_ids``, the piece's ids.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are ascending powers of two")
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    tail = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_length long, step_group long"
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = json_codec(path)
        base = TaskContext.get().partitionId() << 36
        packer, held, serial, group = _Packer(tiers, step_tokens), {}, 0, 0
        number = 0

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal serial, group, held
            if packer.windows:
                lines, ids = [], []
                dealt = packer.steps()
                for window, step in zip(packer.windows, dealt):
                    at, size = 0, sum(n for _, _, n in window)
                    for doc, start, n in window:
                        name, raw = held[doc]
                        own_ids = raw[4 * start : 4 * (start + n)]
                        lines.append((name, start, n, zlib.crc32(own_ids), len(raw) // 4, base + serial, at, size, base + group + step))
                        if with_ids:
                            ids.append(np.frombuffer(own_ids, "<u4").astype(np.int64))
                        at += n
                    serial += 1
                group += max(dealt) + 1
                packer.windows = []
                columns = list(zip(*lines))
                arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
                names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            live = {doc for pile in packer.stock for doc, _ in pile}
            held = {doc: held[doc] for doc in live}

        key_type, fresh = None, 0
        for part in rebatched(batches):
            key_type = part.column("key").type
            for name, raw in zip(part.column("key").to_pylist(), own.encode_batch(strings(part.column("text")))):
                raw += end
                held[number] = (name, raw)
                packer.add(number, len(raw) // 4)
                fresh += len(raw) // 4
                number += 1
            if fresh >= ROUND_TOKENS:
                packer.pack(last=False)
                yield from made()
                fresh = 0
        if key_type is not None:
            packer.pack(last=True)
            yield from made()

    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, {tail}" + ", ids array<long>" * with_ids)
