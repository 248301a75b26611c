"""Collocations: frequent phrases of 2 to 5 words whose parts are rare beside them.

Texts are cut into pieces, and identical pieces of one language become one with a
multiplicity; everything after counts each piece once, by its weight.  Counting has
two passes over the pieces, both out of core in DuckDB, one hash bucket of n-grams a task:

1.  Words and pairs of words as 64-bit hashes.  What reaches ``least`` sets a bit of a filter of
    ``FILTER_BITS`` bits, which has that size whatever the corpus holds.  Every frequent
    n-gram consists of frequent pairs, so a run of pairs whose bits are set holds all of
    them; bits that are set by chance cost work and change nothing.
2.  The n-grams of such runs as texts, counted exactly.  Within a slice of pieces they get exact
    names from the names of their two parts, so that equal ones are added before they
    are sent.

Parts of candidates are looked up by requests that are shuffled to the part's own row.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from .arrays import give_back, mix64, prefix_sums, rebatched, span_hash, utf8

LONGEST = 5
FILTER_BITS = 25
#: Bytes of text that a task holds at once, and what DuckDB may hold before it spills.
SLICE, MEMORY = 3 << 20, "160MB"
MOST_BUCKETS = 8192
#: Tasks that rank a language's candidates before its best ones meet.
SPREAD = 16

_GRAMS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("c", pa.int64())])
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

# Kinds of bytes: part of a word, blank, end of a piece.
_WORD, _BLANK, _END = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = _BLANK
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _runs(solid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a row's end closes a run."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def _texts(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def _cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of byte spans, which may overlap."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    return _texts(raw[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])], offsets)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, piece, words, m): distinct pieces of a slice, words joined by one space."""
    for batch in rebatched(batches, "text", SLICE):
        raw, at = utf8(batch.column("text"))
        kind = _KINDS[raw]
        starts, ends = _runs(kind == _WORD, at)
        if not len(starts):
            continue
        row = np.searchsorted(at, starts, side="right") - 1
        stops = np.concatenate([[0], np.cumsum(kind == _END)])
        new = np.ones(len(starts), bool)
        new[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
        keep = kind == _WORD
        text, joints = _LOWER[raw], starts[1:][~new[1:]] - 1
        keep[joints], text[joints] = True, 0x20
        place = np.cumsum(keep) - keep
        first = np.flatnonzero(new)
        piece = _texts(text[keep], np.append(place[starts[first]], keep.sum()))
        words = np.diff(np.append(first, len(starts)))
        lang = batch.column("lang").fill_null("und").take(pa.array(row[first]))
        table = pa.table({"lang": lang, "piece": piece, "words": words}).group_by(["lang", "piece"]).aggregate([("words", "max"), ([], "count_all")])
        columns = [table.column("lang"), table.column("piece").cast(pa.string()), table.column("words_max"), table.column("count_all")]
        yield from pa.table(columns, names=["lang", "piece", "words", "m"]).to_batches()


class Slice:
    """Words of a slice of pieces: exact numbers within the slice, hashes that hold everywhere."""

    def __init__(self, batch: pa.RecordBatch):
        self.raw, at = utf8(batch.column("piece"))
        solid = self.raw != 0x20
        self.starts, self.ends = _runs(solid, at)
        row = np.searchsorted(at, self.starts, side="right") - 1
        coded = _texts(self.raw[solid], np.concatenate([[0], np.cumsum(self.ends - self.starts)])).dictionary_encode()
        self.word = coded.indices.to_numpy().astype(np.int64)
        own, bounds = utf8(coded.dictionary)
        langs = batch.column("lang").dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy()[row].astype(np.int64)
        self.seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], np.uint64)
        self.single = mix64(span_hash(prefix_sums(own), bounds[:-1], bounds[1:])[self.word] ^ self.seeds[self.lang])
        self.weight = batch.column("m").to_numpy()[row]
        self.follows = np.zeros(len(row), bool)
        self.follows[:-1] = row[1:] == row[:-1]
        self.pair = joined(self.single[:-1], self.single[1:])


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _LEFT + right * _RIGHT)


def _added(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = keys.argsort()
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def hashed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, counts): hashes of words and pairs with their weights; a bucket is a hash's first bits."""
    for batch in rebatched(batches, "piece", SLICE):
        s = Slice(batch)
        if not len(s.word):
            continue
        two = np.flatnonzero(s.follows)
        keys, counts = _added(np.concatenate([s.single, s.pair[two]]), np.concatenate([s.weight, s.weight[two]]))
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        there, first = np.unique(bucket, return_index=True)
        edges = [*first.tolist(), len(keys)]
        for a in range(0, len(there), 256):  # few large rows a batch
            some = range(a, min(a + 256, len(there)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(there[a : a + 256]), *(pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary()) for x in (keys, counts))],
                names=["bucket", "keys", "counts"],
            )


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, sql: str) -> Iterator[pa.RecordBatch]:
    """The query over ``rows``; DuckDB spills to the task's scratch folder, which goes with the task."""
    with tempfile.TemporaryDirectory(prefix="grams-") as scratch:
        settings = {"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}
        with duckdb.connect(config=settings) as con:
            rows = pa.RecordBatchReader.from_batches(schema, batches)
            con.register("rows", rows)
            yield from con.sql(sql).to_arrow_reader(1 << 16)
    give_back()


def frequent_bits(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, bitmap): the bits of the filter that a bucket's frequent hashes set."""
    schema = pa.schema([("h", pa.uint64()), ("c", pa.int64())])

    def unpacked() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                pair = [pa.array(np.frombuffer(x.as_buffer(), kind)) for x, kind in ((keys, np.uint64), (counts, np.int64))]
                yield pa.RecordBatch.from_arrays(pair, schema=schema)

    size, own = 1 << (FILTER_BITS - bits), {}
    for found in _counted(unpacked(), schema, f"SELECT h FROM rows GROUP BY h HAVING sum(c) >= {least}"):
        place = (found.column("h").to_numpy() >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        for bucket in np.unique(place // size).tolist():
            own.setdefault(bucket, np.zeros(size, bool))[place[place // size == bucket] % size] = True
    rows = [pa.array(list(own), pa.int64()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(rows, names=["bucket", "bitmap"])


def grams(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(hash, and lang, n, phrase, c) a slice: n-grams of runs whose words and pairs are all in the filter."""

    def in_filter(keys: np.ndarray) -> np.ndarray:
        place = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1

    for batch in rebatched(batches, "piece", SLICE):
        s = Slice(batch)
        if not len(s.word):
            continue
        sums, keys, tables = prefix_sums(s.raw), [], []
        key, at = (s.lang << 32) | s.word, np.flatnonzero(in_filter(s.single))
        names = np.full(len(s.word), -1, np.int64)
        for n in range(1, LONGEST + 1):
            if n == 2:
                at = np.flatnonzero((names[:-1] >= 0) & (names[1:] >= 0) & s.follows[:-1])
                at = at[in_filter(s.pair[at])]
            elif n > 2:
                # Two parts that overlap and lie in one piece make one n-gram.
                at = np.flatnonzero((names[:-1] >= 0) & (names[1:] >= 0))
            if not len(at):
                break
            key = key[at] if n == 1 else (names[at] << 32) | names[at + 1]
            _, first, name = np.unique(key, return_index=True, return_inverse=True)
            names = np.full(len(s.word), -1, np.int64)
            names[at] = name
            counts = np.zeros(len(first), np.int64)
            np.add.at(counts, name, s.weight[at])
            spot = at[first]
            keys.append(span_hash(sums, s.starts[spot], s.ends[spot + n - 1]) ^ s.seeds[s.lang[spot]])
            columns = [s.langs.take(pa.array(s.lang[spot])), pa.array(np.full(len(spot), n, np.int32)), _cut(s.raw, s.starts[spot], s.ends[spot + n - 1]).cast(pa.string()), pa.array(counts)]
            tables.append(pa.table(columns, schema=_GRAMS))
        if tables:
            yield np.concatenate(keys), pa.concat_tables(tables)


def packed(slices: Iterator[tuple[np.ndarray, pa.Table]], bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block): a slice's n-grams of one bucket as one block of rows."""
    for keys, table in slices:
        bucket = (mix64(keys) >> np.uint64(64 - bits)).astype(np.int64)
        order = bucket.argsort(kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        there, first = np.unique(bucket[order], return_index=True)
        blocks = []
        for a, b in zip(first, [*first[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _GRAMS) as out:
                out.write_table(table.slice(a, b - a))
            blocks.append(sink.getvalue().to_pybytes())
        for a in range(0, len(there), 256):  # few large rows a batch
            yield pa.RecordBatch.from_arrays([pa.array(there[a : a + 256]), pa.array(blocks[a : a + 256], pa.binary())], names=["bucket", "block"])


def counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, n, phrase, f): the n-grams of a task's buckets that occur ``least`` times."""

    def unpacked() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                yield from pa.ipc.open_stream(block.as_buffer())

    return _counted(unpacked(), _GRAMS, f"SELECT lang, n, phrase, CAST(sum(c) AS BIGINT) AS f FROM rows GROUP BY ALL HAVING sum(c) >= {least}")


def frequent(pieces_: DataFrame, least: int) -> DataFrame:
    """(lang, n, phrase, f): all n-grams of at most ``LONGEST`` words that occur ``least`` times."""
    spark = pieces_.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    bits = max(4, min((4 * tasks - 1).bit_length(), MOST_BUCKETS.bit_length() - 1))
    rows = pieces_.select("lang", "piece", "m")
    dealt = rows.mapInArrow(lambda b: hashed(b, bits), "bucket long, keys binary, counts binary").repartition(tasks, "bucket")
    # Together of a fixed size: one bit a place of the filter.
    found = dealt.mapInArrow(lambda b: frequent_bits(b, least, bits), "bucket long, bitmap binary").collect()
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    share = len(bitmap) >> bits
    for row in found:
        bitmap[row["bucket"] * share : (row["bucket"] + 1) * share] |= np.frombuffer(row["bitmap"], np.uint8)
    filter_ = spark.sparkContext.broadcast(bitmap)
    sent = rows.mapInArrow(lambda b: packed(grams(b, filter_.value), bits), "bucket long, block binary").repartition(tasks, "bucket")
    return sent.mapInArrow(lambda b: counted(b, least), "lang string, n int, phrase string, f long")


def mine(docs: DataFrame, least: int = 100, cover: int = 100, best: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases.

    A is lower-cased as a, other letters stay.  Null texts have no words, a null language is
    ``und``.  Repeated rows count again.  A candidate occurs ``least`` times; it goes
    if a longer one around it has ``cover`` per cent of its occurrences, which one of the two that
    are a word longer then has as well.  Ties by score go to the more frequent phrase,
    then to the smaller one in byte order.  An empty table gives no rows.
    """
    if least < 1 or best < 1 or not 0 < cover <= 100:
        raise ValueError("least and best are at least 1, cover is a percentage")
    rows = docs.select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"))
    cut = rows.mapInArrow(pieces, "lang string, piece string, words long, m long")
    spark, path = docs.sparkSession, f"{shared.folder(docs.sparkSession)}/pieces-{uuid.uuid4().hex}"
    cut.groupBy("lang", "piece").agg(F.max("words").alias("words"), F.sum("m").alias("m")).write.parquet(path)
    distinct = spark.read.parquet(path)
    totals = shared.kept(distinct.groupBy("lang").agg(F.sum(F.col("m") * F.col("words")).alias("n")))
    counts = shared.written(frequent(distinct, least), "grams")
    shared.delete(spark, path)  # what follows reads counts and totals alone

    words = F.split("phrase", " ", -1)
    span = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    longer = counts.filter("n >= 3").select("lang", "f", F.explode(F.array(span(F.lit(1), F.col("n") - 1), span(F.lit(2), F.col("n") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    candidates = counts.filter("n >= 2").withColumnRenamed("f", "a").withColumnRenamed("n", "size")
    kept = candidates.join(longer.hint("merge"), ["lang", "phrase"], "left").filter(F.coalesce(F.col("most") * 100 < F.col("a") * cover, F.lit(True)))
    cuts = kept.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("first"), span(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left, right = (counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).hint("merge") for part, name in (("first", "l"), ("rest", "r")))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = met.withColumn("top", F.lit(1000).cast("decimal(38,0)") * F.col("a") * F.col("n")).withColumn("bottom", wide("l") * F.col("r"))
    scored = scored.withColumn("score", F.expr("top div bottom"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    flat = lowest.select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
