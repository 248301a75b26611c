"""Substring deduplication over a compacted De Bruijn graph of word k-mers.

Edges are k-mers, runs of k consecutive words.  Writing an edge for every word would
move far more than the text, so edges are compacted before they move: consecutive
edges with the same minimizer (the least hash of the m-mers within them, leftmost on
ties) form a path without branches, a super-k-mer, and only that path's fingerprint,
seed and source coordinates are shuffled, packed by shard of the seed.  Then

1. equal paths meet in their seed's shard: all but the first source are repeats whole,
2. paths that share a seed but differ, where a repeat ends inside a path, are joined
   back to their source documents, and their single edges meet by fingerprint,
3. the repeated spans, compacted to maximal runs, are joined with their documents.

A k-mer that repeats has the same minimizer everywhere, so its paths meet.  What a
third of all rows share is reduced before it moves: a batch sends one source of each
path and edge and bare coordinates of the others, and only a few paths of a seed to
the seed's shard.  Fingerprints have 96 (paths) and 128 (edges) bits.

Null texts have no words.  A document is its key with its text: rows that repeat both
are one document and get one result each; order is by key (nulls first), then by a
hash of the text.  Keys that are not unique whole numbers are ranked first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept, written
from .arrays import mix64, prefix_sums, rebatched, span_hash, utf8, window_hash, word_bounds

WORDS = 20
SEED = 6
BATCH_BYTES = 3 << 20
#: Paths of one seed that a batch sends to the seed's shard.
HOT = 8
#: A path's packed coordinate: first edge's word number, then edges less one.
_COUNT_BITS = 6


def _word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(raw, at)
    return span_hash(prefix_sums(raw), starts, ends), first


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the first on ties."""
    place = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        ahead, ahead_place = values[step:], place[step:]
        values, place = values[: len(ahead)], place[: len(ahead)]
        later = ahead < values
        values, place = np.where(later, ahead, values), np.where(later, ahead_place, place)
        span += step
    return place


def paths(words: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of documents' words: (document, first edge, edges, seed hash, two fingerprints)."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(first)
    if len(words) < k:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    begin = np.arange(len(words) - m + 1)
    seeds = window_hash(words, begin, begin + m)
    least = _least(seeds, k - m + 1)
    edges = np.maximum(sizes - k + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), edges)
    start = np.arange(len(owner)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(edges)[:-1]]), edges)
    place = least[start]
    cut = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    count = np.diff(np.append(cut, len(owner)))
    a = start[cut]
    mark = mix64(((place[cut] - a) << 8 | count).astype(np.uint64))
    one = window_hash(words, a, a + count + k - 1, 0) ^ mark
    two = window_hash(words, a, a + count + k - 1, 1) ^ mark
    return owner[cut], a - first[owner[cut]], count, seeds[place[cut]], one, two


def ranked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents as (id, text), rows as (id, key, text, row) or None where the key is the id).

    Ids are unique whole numbers in the documents' order; ``row`` has all columns.
    """
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(docs[key].alias("key"), content.alias("text"), whole.alias("row"))
    kind = rows.schema["key"].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        clash = docs.groupBy(docs[key].alias("key")).count().filter((F.col("count") > 1) | F.col("key").isNull())
        if clash.isEmpty():
            return rows.select(F.col("key").cast("long").alias("id"), "text").filter("id is not null"), None
    tied = rows.withColumn("tie", F.xxhash64("text"))
    order = tied.select("key", "tie").distinct().orderBy(F.col("key").asc_nulls_first(), "tie").withColumn("id", F.monotonically_increasing_id())
    order = kept(order).select(F.col("key").alias("k"), F.col("tie").alias("t"), "id")
    joined = tied.join(order, F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t"))).select("id", "key", "text", "row")
    return joined.select("id", "text"), joined


def pack(values: np.ndarray) -> bytes:
    """Unsigned whole numbers by byte planes, compressed."""
    most = int(values.max()) if len(values) else 0
    wide = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    raw = np.ascontiguousarray(values.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes()
    return bytes([wide]) + len(values).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    wide, n = data[0], int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], n * wide, "zstd", asbytes=True) if n else b""
    return np.frombuffer(raw, np.uint8).reshape(wide, n).T.copy().view(f"<u{wide}").reshape(-1).astype(np.uint64)


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed whole numbers as unsigned ones, small ones small."""
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def _leads(groups: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in source order, the first of each group of equal rows, and all others."""
    order = np.lexsort(groups[::-1])
    fresh = np.zeros(len(order), bool)
    for x in groups:
        fresh[1:] |= x[order[1:]] != x[order[:-1]]
    fresh[:1] = True
    return np.sort(order[fresh]), np.sort(order[~fresh])


def _in_order(part: pa.RecordBatch) -> pa.RecordBatch:
    return part.take(pa.array(np.argsort(part.column("id").to_numpy(), kind="stable")))


def _by_shard(shard: np.ndarray, order: np.ndarray, columns: dict[str, np.ndarray], deltas: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A row for each shard with its part of each column packed, in the given order."""
    line = order[np.argsort(shard[order], kind="stable")]
    used, first = np.unique(shard[line], return_index=True)
    if not len(used):
        return
    edges = list(zip(first, np.append(first[1:], len(line))))
    arrays, names = [pa.array(used)], ["shard"]
    for name, values in columns.items():
        taken = values[line]
        arrays.append(pa.array([pack(np.diff(taken[a:b], prepend=taken[:0].dtype.type(0)) if name in deltas else taken[a:b]) for a, b in edges], pa.binary()))
        names.append(name)
    yield pa.RecordBatch.from_arrays(arrays, names=names)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _whole(table: pa.Table, name: str, delta: bool = False) -> np.ndarray:
    parts = [unpack(x) for x in table.column(name).to_pylist() if x is not None]
    return np.concatenate([np.cumsum(x) if delta else x for x in parts] or [np.zeros(0, np.uint64)])


def _send_paths(batches: Iterator[pa.RecordBatch], k: int, m: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Paths of each batch to the shards of their seeds.

    A path that an earlier source of the batch has is a repeat already (``again``), and
    travels as a bare coordinate.  Of a seed with many paths in the batch a few go to
    its shard; the others surely share their seed (``sure``), and go to any shard.
    """
    for part in rebatched(batches, most=BATCH_BYTES):
        part = _in_order(part)
        owner, start, count, seed, one, two = paths(*_word_hashes(*utf8(part.column("text"))), k, m)
        if not len(owner):
            continue
        ids = part.column("id").to_numpy()[owner]
        extra = two >> np.uint64(32)
        spot = start << _COUNT_BITS | (count - 1)
        lead, again = _leads((one, extra))
        turn = np.argsort(seed[lead], kind="stable")
        sorted_seed = seed[lead][turn]
        place = np.empty(len(lead), np.int64)
        place[turn] = np.arange(len(lead)) - np.searchsorted(sorted_seed, sorted_seed)
        home, sure = lead[place < HOT], lead[place >= HOT]
        columns = {"id": zigzag(ids), "spot": spot.astype(np.uint64)}
        full = {"seed": seed, "path": one, "extra": extra} | columns
        for kind, own, key, sent in ((0, home, seed, full), (1, again, one, columns), (2, sure, one, columns)):
            order = own[np.argsort(seed[own], kind="stable")] if kind == 0 else own
            for batch in _by_shard(_shard_of(key, shards), order, sent, ("seed",)):
                fields = {n: batch.column(n) for n in batch.schema.names}
                none = pa.nulls(batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [fields["shard"], pa.array([kind] * batch.num_rows, pa.int32()), *(fields.get(n, none) for n in ("seed", "path", "extra", "id", "spot"))],
                    names=["shard", "kind", "seed", "path", "extra", "id", "spot"],
                )


def _meet_paths(table: pa.Table, k: int) -> pa.Table:
    """Repeated spans (size > 0), and first sources of paths that share a seed but differ (size 0)."""
    of = {kind: table.filter(pa.compute.equal(table.column("kind"), kind)) for kind in (0, 1, 2)}
    ids, spots, sizes = [], [], []

    def put(i: np.ndarray, spot: np.ndarray, repeat: bool) -> None:
        ids.append(i)
        spots.append(spot)
        sizes.append(np.full(len(i), repeat))

    for kind in (1, 2):
        put(unzigzag(_whole(of[kind], "id")), _whole(of[kind], "spot").astype(np.int64), kind == 1)
    seed, path, extra = _whole(of[0], "seed", True), _whole(of[0], "path"), _whole(of[0], "extra")
    i, spot = unzigzag(_whole(of[0], "id")), _whole(of[0], "spot").astype(np.int64)
    order = np.lexsort((spot, i))
    seed, path, extra, i, spot = (x[order] for x in (seed, path, extra, i, spot))
    lead, again = _leads((path, extra))
    put(i[again], spot[again], True)
    _, number, n = np.unique(seed[lead], return_inverse=True, return_counts=True)
    mixed = lead[n[number] > 1]
    put(i[mixed], spot[mixed], False)
    i, spot, repeat = np.concatenate(ids), np.concatenate(spots), np.concatenate(sizes)
    count = (spot & ((1 << _COUNT_BITS) - 1)) + 1
    return pa.table({"id": pa.array(i), "start": pa.array(spot >> _COUNT_BITS), "count": pa.array(count), "size": pa.array(np.where(repeat, count + k - 1, 0))})


def _send_edges(batches: Iterator[pa.RecordBatch], k: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Single edges of paths back at their sources, to the shards of the edges' fingerprints."""
    for part in rebatched(batches, most=BATCH_BYTES):
        part = _in_order(part)
        words, at = _word_hashes(*utf8(part.column("text")))
        spots = part.column("spots")
        flat = spots.flatten()
        owner = np.repeat(np.arange(part.num_rows), np.diff(spots.offsets.to_numpy()))
        n = flat.field("count").to_numpy()
        if not len(n):
            continue
        begin = np.repeat(flat.field("start").to_numpy(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(owner, n)
        line = np.lexsort((begin, owner))
        owner, begin = owner[line], begin[line]
        one, two = (window_hash(words, at[owner] + begin, at[owner] + begin + k, f) for f in (0, 1))
        ids = part.column("id").to_numpy()[owner]
        lead, again = _leads((one, two))
        columns = {"id": zigzag(ids), "spot": begin.astype(np.uint64)}
        for kind, own, sent in ((0, lead, {"path": one, "extra": two} | columns), (1, again, columns)):
            order = own[np.argsort(one[own], kind="stable")]
            for batch in _by_shard(_shard_of(one, shards), order, sent, ("path",)):
                fields = {n: batch.column(n) for n in batch.schema.names}
                none = pa.nulls(batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([fields["shard"], pa.array([kind] * batch.num_rows, pa.int32()), *(fields.get(n, none) for n in ("path", "extra", "id", "spot"))], names=["shard", "kind", "path", "extra", "id", "spot"])


def _meet_edges(table: pa.Table, k: int) -> pa.Table:
    first = table.filter(pa.compute.equal(table.column("kind"), 0))
    rest = table.filter(pa.compute.equal(table.column("kind"), 1))
    i, start = unzigzag(_whole(first, "id")), _whole(first, "spot").astype(np.int64)
    one, two = _whole(first, "path", True), _whole(first, "extra")
    order = np.lexsort((start, i))
    i, start, one, two = (x[order] for x in (i, start, one, two))
    _, again = _leads((one, two))
    i = np.concatenate([i[again], unzigzag(_whole(rest, "id"))])
    start = np.concatenate([start[again], _whole(rest, "spot").astype(np.int64)])
    return pa.table({"id": pa.array(i), "start": pa.array(start), "size": pa.array(np.full(len(i), k))})


def repeats(documents: DataFrame, k: int = WORDS, m: int = SEED) -> DataFrame:
    """(id, start, size) word spans of (id, text) that are covered by k-mers starting earlier too.

    Spans may overlap; starts count words from 0.
    """
    if not 0 < m < k or k - m >= 1 << _COUNT_BITS:
        raise ValueError(f"0 < m < k and k - m < {1 << _COUNT_BITS}")
    shards = max(16, 2 * documents.rdd.getNumPartitions())
    sent = documents.mapInArrow(lambda b: _send_paths(b, k, m, shards), "shard long, kind int, seed binary, path binary, extra binary, id binary, spot binary")
    met = written(sent.groupBy("shard").applyInArrow(lambda t: _meet_paths(t, k), "id long, start long, count long, size long"))
    mixed = met.filter("size = 0").groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("start", "count")).alias("spots"))
    back = documents.join(mixed.hint("merge"), F.col("id") == F.col("of")).select("id", "text", "spots")
    single = back.mapInArrow(lambda b: _send_edges(b, k, shards), "shard long, kind int, path binary, extra binary, id binary, spot binary")
    later = single.groupBy("shard").applyInArrow(lambda t: _meet_edges(t, k), "id long, start long, size long")
    return met.filter("size > 0").select("id", "start", "size").unionByName(later)


def compacted(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [start, stop) of overlapping or touching (start, size) spans."""
    out: list[tuple[int, int]] = []
    for start, size in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + size))
        else:
            out.append((start, start + size))
    return out


def _spans(documents: DataFrame, k: int, m: int) -> DataFrame:
    return repeats(documents, k, m).groupBy("id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def kept_text(content: str, runs: list[tuple[int, int]]) -> str:
    """A text without the words of these runs; what stays between two runs keeps its white space."""
    if not runs:
        return content
    view = np.frombuffer(raw := content.encode(), np.uint8)
    starts, ends, _ = word_bounds(view, np.array([0, len(view)]))
    edges = [0, *[x for run in runs for x in run], len(starts)]
    return b" ".join([raw[starts[a] : ends[b - 1]] for a, b in zip(edges[::2], edges[1::2]) if a < b]).decode()


def stripped(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, m: int = SEED) -> DataFrame:
    """The rows, all columns, with repeated words taken out of the text (null texts become empty).

    Other columns travel with the spans, so that the text is shuffled once.  Of rows
    that repeat key and text each is kept.
    """
    documents, rows = ranked(docs, key, text)
    if rows is None:
        light = docs.select(docs[key].cast("long").alias("of"), F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text]).alias("row"))
    else:
        documents = documents.dropDuplicates(["id"])
        light = rows.select(F.col("id").alias("of"), F.struct(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text]).alias("row"))
    spans = _spans(documents, k, m).withColumnRenamed("id", "s")
    light = light.join(spans.hint("merge"), F.col("of") == F.col("s"), "left").select("of", "row", "spans")
    joined = documents.join(light.hint("merge"), F.col("id") == F.col("of")).select("text", "row", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rebatched(batches):
            texts = [kept_text(t, compacted([(x["start"], x["size"]) for x in s or ()])) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = joined.mapInArrow(cut, T.StructType([joined.schema["row"]]).add("text", "string"))
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _with_spans(documents: DataFrame, k: int, m: int) -> DataFrame:
    spans = _spans(documents, k, m)
    return documents.join(spans.select(F.col("id").alias("of"), "spans").hint("merge"), F.col("id") == F.col("of"), "left").select("id", "text", "spans")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, m: int = SEED, digests: bool = False) -> DataFrame:
    """Each document with its repeated words taken out.

    Returns the key, n_words, n_removed and kept_text, where what stays keeps its white
    space, runs are joined by one space and a text without repeats is unchanged; or
    with ``digests`` kept_sha256 of the kept words joined by one space.
    """
    documents, rows = ranked(docs, key, text)
    last = "kept_sha256" if digests else "kept_text"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rebatched(batches):
            words, gone, kept = [], [], []
            for content, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw = content.encode()
                runs = compacted([(s["start"], s["size"]) for s in spans or ()])
                parts = raw.split()
                n = sum(b - a for a, b in runs)
                stay, at = [], 0
                for a, b in [*runs, (len(parts), len(parts))]:
                    if a > at:
                        stay.append((at, a))
                    at = b
                words.append(len(parts))
                gone.append(n)
                if digests:
                    kept.append(hashlib.sha256(b" ".join([w for a, b in stay for w in parts[a:b]])).hexdigest())
                else:
                    kept.append(kept_text(content, runs))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", last])

    out = _with_spans(documents, k, m).mapInArrow(cut, f"id long, n_words long, n_removed long, {last} string")
    if rows is None:
        return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "n_words", "n_removed", last)
    return rows.select("id", F.col("key").alias(key)).join(out.dropDuplicates(["id"]), "id").select(key, "n_words", "n_removed", last)
