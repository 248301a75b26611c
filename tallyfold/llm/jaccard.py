"""Similarity join on word shingles by chosen paths.

Each text's set of five-word shingles is embedded as minhash coordinates.  In every
run a set follows the path of a sampled coordinate's token; sets that share the token
meet in a bucket.  Buckets over a limit split again on two more coordinates, which the
path's hash chooses for all its sets alike; small buckets are compared directly, and
what is still large after the last split is compared in blocks, so nothing is dropped.
Runs repeat until a pair at the threshold is missed with probability ``MISS`` at most.

Buckets only propose groups: sets whose signatures agree enough are linked by a forest,
never by all pairs, and the forests' components are groups.  Within a group exact
Jaccard similarities of the whole sets decide; large groups are compared in blocks.
What leaves the comparison is a count of links for each set, and a forest of them.

Words are ``[^\\x20\\x09-\\x0D]+`` unchanged.  A text of one to four words has one
shingle, all of it; one without words has none and links to nothing.  Texts of equal
word sequences are copies: they share one set and are counted, not paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .arrays import give_back, mix64, rebatched, utf8, window_hash
from .components import components
from .substrings import _word_hashes, ranked

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
#: A pair at the threshold is missed with at most this probability: half for all runs, half for the signatures' agreement.
MISS = 1e-8
BUCKET = 64
BLOCK = 512
SPLITS = 1
CHUNK = 4096

_FACTORS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def likely_for(threshold: float, miss: float = MISS / 2) -> int:
    """Coordinates that a pair at the threshold shares with probability 1 - ``miss`` at least."""
    below = 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        if below > miss:
            return k
    return COORDINATES


def runs_for(threshold: float, miss: float = MISS / 2) -> int:
    """Runs after which a pair at the threshold is missed with probability ``miss`` at most.

    A pair meets in a run's first bucket with probability ``threshold``, and in one of two
    branches of each split with 1 - (1 - threshold)**2.
    """
    meet = threshold * (1 - (1 - threshold) ** 2) ** SPLITS
    runs = math.ceil(math.log(miss) / math.log(1 - meet)) if meet < 1 else 1
    if runs > COORDINATES:
        raise ValueError(f"a threshold of {threshold} takes {runs} runs, more than the {COORDINATES} coordinates allow")
    return runs


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of documents' words, end to end, and each document's first."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    stop = start + np.repeat(np.minimum(n, size), count)
    return window_hash(words, start, stop), at


def _signatures(batches: Iterator[pa.RecordBatch], size: int, runs: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints, minhash coordinates (16 bits each) and each run's first path, from its coordinate's whole token."""
    for part in rebatched(batches, most=2 << 20):
        words, first = _word_hashes(*utf8(part.column("text")))
        tokens, at = shingles(words, first, size)
        full = np.flatnonzero(np.diff(at))
        sums = [window_hash(words, first[:-1], first[1:], f).view(np.int64) for f in (0, 1)]
        grid = np.empty((len(full), COORDINATES), "<u2")
        first_paths = np.empty((len(full), runs), np.int64)
        for k, factor in enumerate(_FACTORS if len(full) else ()):
            least = mix64(np.minimum.reduceat(tokens * factor, at[full]))
            grid[:, k] = least & np.uint64(0xFFFF)
            if k < runs:
                first_paths[:, k] = mix64(least + np.uint64(k)).view(np.int64)
        ids = part.column("id").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[full]), pa.array(sums[0][full]), pa.array(sums[1][full]), pa.array([x.tobytes() for x in grid], pa.binary()), pa.array(list(first_paths), pa.list_(pa.int64()))],
            names=["id", "one", "two", "sig", "paths"],
        )


def _coordinate(column: str) -> F.Column:
    """The coordinate of a signature that a column numbers, in hexadecimal digits."""
    return F.hex(F.expr(f"substring(sig, 2 * {column} + 1, 2)"))


def _alike(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of each row of ``sig`` with each of ``other``."""
    out = np.empty((len(sig), len(other)), np.float32)
    for i in range(len(sig)):
        out[i] = (other == sig[i]).mean(1)
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the given edges among n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of rows with equal values of a sorted column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(column)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _propose(batches: Iterator[pa.RecordBatch], likely: int) -> Iterator[pa.RecordBatch]:
    """A forest of likely pairs of each bucket or pair of blocks."""
    for group in _grouped(batches, "task"):
        ids = group.column("id").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(ids), -1)
        side = group.column("side").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, sig, side = ids[order], sig[order], side[order]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        i, j = np.nonzero(_alike(sig[left], sig[right]) * COORDINATES >= likely)
        a, b = left[i], right[j]
        keep = ids[a] != ids[b]
        edges = _forest(len(ids), a[keep], b[keep])
        if edges:
            x, y = zip(*edges)
            yield pa.RecordBatch.from_arrays([pa.array(ids[list(x)]), pa.array(ids[list(y)])], names=["a", "b"])
    give_back()


def _tasks(rows: DataFrame, group: str, limit: int, block: int) -> DataFrame:
    """Rows with a task for each group of at most ``limit`` rows and each pair of blocks of larger ones.

    Adds task (a number) and side: 2 for both sides of a pair, 0 for its left, 1 for its right.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(group).alias("g"), "n")
    sized = rows.join(sizes.hint("merge"), F.col(group) == F.col("g")).drop("g")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(77)), F.when(F.col("n") > limit, blocks).otherwise(F.lit(1)).cast("long")).cast("int")
    sized = sized.withColumn("own", own).withColumn("blocks", F.when(F.col("n") > limit, blocks).otherwise(F.lit(1)))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sized.withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    return pairs.withColumn("task", F.xxhash64(group, low, high)).withColumn("side", side).withColumn("whole", F.col("blocks") == 1).drop("own", "other", "blocks", "n")


def proposals(sets: DataFrame, bucket: int = BUCKET, block: int = BLOCK, likely: int = likely_for(THRESHOLD)) -> DataFrame:
    """(a, b) forests of likely similar sets, from (id, sig, paths).

    Paths travel without signatures until it is known which of them sets share.
    """
    rows = sets.select("id", F.explode("paths").alias("path"))
    signed = sets.select(F.col("id").alias("of"), "sig")
    for depth in range(SPLITS):
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("path").alias("p"), "n")
        sized = rows.join(sizes.hint("merge"), F.col("path") == F.col("p")).select("id", "path", (F.col("n") > bucket).alias("large"))
        sized = kept(sized)
        split = sized.filter("large").join(signed.hint("merge"), F.col("id") == F.col("of"))
        for branch in (0, 1):
            split = split.withColumn(f"k{branch}", F.pmod(F.xxhash64("path", F.lit(100 * depth + branch)), F.lit(COORDINATES)).cast("int"))
        branches = [F.xxhash64("path", F.lit(b), _coordinate(f"k{b}")) for b in (0, 1)]
        rows = sized.filter("not large").select("id", "path").unionByName(split.select("id", F.explode(F.array(*branches)).alias("path")))
    tasks = _tasks(rows, "path", bucket, block).select("task", "side", F.col("id").alias("i"))
    tasks = tasks.join(signed.hint("merge"), F.col("i") == F.col("of")).select("task", "side", F.col("i").alias("id"), "sig")
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: _propose(b, likely), "a long, b long")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of intersections of sets, by products of incidence matrices a chunk of tokens wide."""
    sizes = np.array([len(s) for s in sets])
    tokens, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = seen[number] > 1
    order = np.argsort(number[shared], kind="stable")
    number, owner = number[shared][order], owner[shared][order]
    _, number = np.unique(number, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, width, CHUNK):
        a, b = np.searchsorted(number, (low, low + CHUNK))
        grid = np.zeros((len(sets), min(CHUNK, width - low)), np.float32)
        grid[owner[a:b], number[a:b] - low] = 1
        out += grid[left] @ grid[right].T
    return out


def _compare(batches: Iterator[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each set of a group or pair of blocks its links, and a forest of links.

    ``link`` is another node of the forest, or null in a row that only counts.
    """
    for group in _grouped(batches, "task"):
        table = group.combine_chunks()
        ids = table.column("id").to_numpy()
        _, pick = np.unique(ids, return_index=True)
        table = table.take(pa.array(pick))
        ids, side, copies = (table.column(c).to_numpy() for c in ("id", "side", "copies"))
        words, first = _word_hashes(*utf8(table.column("text")))
        tokens, at = shingles(words, first, size)
        sets = [np.unique(tokens[a:b]) for a, b in zip(at, at[1:])]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            continue
        n = np.array([len(s) for s in sets], np.float64)
        both = _overlaps(sets, left, right).astype(np.float64)
        linked = both >= threshold * (n[left][:, None] + n[right][None] - both) - 1e-9
        linked &= ids[left][:, None] != ids[right][None]
        links = np.zeros(len(ids), np.int64)
        links[left] += linked @ copies[right]
        if side[0] != 2:
            links[right] += copies[left] @ linked
        i, j = np.nonzero(linked)
        edges = _forest(len(ids), left[i], right[j])
        some = np.flatnonzero(links)
        x, y = (list(z) for z in zip(*edges)) if edges else ([], [])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], ids[x]]).astype(np.int64)),
                pa.array(np.concatenate([links[some], np.zeros(len(x), np.int64)])),
                pa.array([None] * len(some) + ids[y].tolist(), pa.int64()),
            ],
            names=["id", "links", "link"],
        )
    give_back()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """Every row with class_id, the smallest key of its component of links, and n_links.

    ``n_links`` counts other rows whose similarity with this one is at least the
    threshold, copies among them.  A threshold too low for the coordinates (below about
    0.4) is an error.  Rows that repeat key and text are one document.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is in (0, 1]")
    documents, rows = ranked(docs, key, text)
    if rows is not None:
        documents = documents.dropDuplicates(["id"])
    runs = runs_for(threshold)
    signed = kept(documents.mapInArrow(lambda b: _signatures(b, size, runs), "id long, one long, two long, sig binary, paths array<long>"))
    sets = signed.groupBy("one", "two").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.min("paths").alias("paths"))
    likely = components(proposals(sets.select("id", "sig", "paths"), likely=likely_for(threshold)))

    # Groups of likely similar sets, compared exactly.
    members = likely.select(F.col("node").alias("m"), F.col("root").alias("task_group")).join(sets.select("id", "copies").hint("merge"), F.col("m") == F.col("id"))
    texts = documents.select(F.col("id").alias("i"), "text")
    grouped = _tasks(members.select("id", "task_group", "copies"), "task_group", BLOCK, BLOCK)
    wanted = grouped.groupBy("id").agg(F.collect_list(F.struct("task", "side", "copies")).alias("tasks"))
    loaded = texts.join(wanted.hint("merge"), F.col("i") == F.col("id")).select("id", "text", F.explode("tasks").alias("t")).select("id", "text", "t.*")
    found = kept(loaded.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: _compare(b, size, threshold), "id long, links long, link long"))

    roots = components(found.filter("link is not null").select(F.col("id").alias("a"), F.col("link").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).filter("links > 0").select(F.col("id").alias("l"), "links")
    known = sets.select("one", "two", F.col("id").alias("first"), "copies")
    known = known.join(roots.hint("merge"), F.col("first") == F.col("node"), "left").join(links.hint("merge"), F.col("first") == F.col("l"), "left")
    known = known.select(F.col("one").alias("o"), F.col("two").alias("t"), F.coalesce("root", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classed = signed.select("id", "one", "two").join(known.hint("merge"), (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))).select(F.col("id").alias("c"), "class_id", "n_links")
    base = documents.select("id")
    out = base.join(classed.hint("merge"), F.col("id") == F.col("c"), "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    kind = docs.schema[key].dataType
    if rows is None:
        return out.select(F.col("id").cast(kind).alias(key), F.col("class_id").cast(kind).alias("class_id"), "n_links")
    names = rows.select("id", "key")
    leads = names.dropDuplicates(["id"]).select(F.col("id").alias("class_id"), F.col("key").alias("lead"))
    return names.join(out, "id").join(leads, "class_id").select(F.col("key").alias(key), F.col("lead").alias("class_id"), "n_links")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One document of each component of links, that with the smallest key, all its columns.

    Of rows that repeat key and text one stays; rows that only share a key are judged
    each, null keys first.  Texts without words are alike to none and stay; columns of
    any name are carried along.
    """
    whole = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    content = docs[text].cast("string")
    rows = docs.select(whole.alias("row"), docs[key].alias("k"), content.alias("t"), F.xxhash64(F.coalesce(content, F.lit(""))).alias("tie"))
    if docs.filter(docs[key].isNull()).isEmpty() and docs.groupBy(key).count().filter("count > 1").isEmpty():
        lead = join(docs, key, text, threshold, size).filter(F.col(key) == F.col("class_id")).select(F.col(key).alias("lead"))
        out = rows.join(lead.hint("merge"), F.col("k") == F.col("lead"), "left_semi")
    else:
        single = rows.dropDuplicates(["k", "tie"])
        order = kept(single.select(F.col("k").alias("own"), F.col("tie").alias("mark")).orderBy(F.col("k").asc_nulls_first(), "tie").withColumn("n", F.monotonically_increasing_id()))
        numbered = single.join(order, F.col("k").eqNullSafe(F.col("own")) & (F.col("tie") == F.col("mark")))
        lead = join(numbered.select("n", "t"), "n", "t", threshold, size).filter("n = class_id").select(F.col("n").alias("lead"))
        out = numbered.join(lead, F.col("n") == F.col("lead"), "left_semi")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
