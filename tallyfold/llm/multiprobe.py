"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are lengthened by one component to one common norm R, so that inner products order
as distances do; queries get a zero there.  A table's bucket is the tuple of slots
floor((a x + b) / W) of a few Gaussian projections.  For a random projection, a neighbour
whose inner product with the query is s lies, given the query's own place, at a
normally distributed one: mean s / |q|^2 times the query's, variance R^2 - s^2 / |q|^2.
So each bucket near a query has an estimated probability of holding that neighbour.
Buckets are visited from the most probable one on until their sum reaches what the tables need
together for the wanted recall; s is the score of the kth neighbour, or a lower bound of it.

That bound comes from a bounded sample, and from the best buckets, which a first round
visits; scores below the k best of that round are of no use to the second.  Every vector is in one bucket of every table, and buckets of any size stand in shards of
at most ``SHARD`` rows on average: small buckets share one, a large one is dealt out over
several, which a query that visits it searches all.  Each shard is one row; blocks of
queries stream past it, and a shard returns the k best of each query alone.
What tables find is merged, and candidates are scored again in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

TABLES = 2
#: Estimated probability that a neighbour as far as the kth one is found.
RECALL = 0.95
#: Rows a bucket should hold, rows a shard should hold, queries that one row of a shard's block carries.
BUCKET, SHARD, BLOCK = 512, 8192, 256
#: Vectors from which a first bound of the kth score is taken.
SAMPLE = 2048
#: Buckets that the first round visits in each table.
FIRST = 3
#: A slot's width in norms, and slots on either side of zero; outer slots are open.
WIDTH, SIDE = 1.5, 8
MOST_FUNCTIONS = 15


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, size): vectors with neither null nor non-finite parts nor all parts zero."""
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        part = batch.filter(pa.array(sizes == size))
        yield part, matrix(part.column("v"))


def norms(v: np.ndarray) -> np.ndarray:
    """Norms that neither overflow nor vanish."""
    most = np.abs(v).max(1)
    scaled = v / most[:, None]
    return most * np.sqrt((scaled * scaled).sum(1))


def phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, within 1e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    tail = t * np.exp(
        -z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    )
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


class Hashes:
    """The functions of all tables for vectors of one length and one largest norm."""

    def __init__(self, size: int, rows: int, norm: float, tables: int, bucket: int, seed: int):
        self.norm = norm
        # A function has some 2.8 slots that matter.
        self.functions = max(0, min(MOST_FUNCTIONS, round(math.log(max(1, rows / bucket)) / math.log(2.8))))
        self.tables = tables if self.functions else 1
        draw = np.random.default_rng([seed, size])
        self.a = draw.normal(size=(self.tables, self.functions, size + 1))
        self.b = draw.uniform(0, WIDTH, (self.tables, self.functions))

    def places(self, v: np.ndarray, queries: bool) -> np.ndarray:
        """(tables, rows, functions) projections in norms."""
        v = v / self.norm
        last = np.zeros(len(v)) if queries else np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))
        return np.einsum("nd,tfd->tnf", np.column_stack([v, last]), self.a)

    def buckets(self, v: np.ndarray) -> np.ndarray:
        """(tables, rows) bucket numbers: four bits a function."""
        slots = np.clip(np.floor((self.places(v, False) + self.b[:, None]) / WIDTH), -SIDE, SIDE - 1).astype(np.int64) + SIDE
        return (slots << (4 * np.arange(self.functions))).sum(-1)

    def chances(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """(tables, rows, functions, slots): where a neighbour of that inner product may lie."""
        size = norms(v) / self.norm
        # Cosine of the angle, with the common norm of all vectors.
        cosine = np.clip(score / self.norm**2 / size, -1, 1 - 1e-12)
        mean = self.places(v, True) * (cosine / size)[:, None]
        spread = np.sqrt(1 - cosine * cosine)[:, None, None]
        edges = np.arange(-SIDE + 1, SIDE) * WIDTH - self.b[..., None]
        below = phi((edges[:, None] - mean[..., None]) / spread)
        full = np.concatenate([np.zeros((*below.shape[:-1], 1)), below, np.ones((*below.shape[:-1], 1))], -1)
        return np.diff(full, axis=-1)


def probes(chance: np.ndarray, wanted: float, most: int | None = None) -> list[int]:
    """Buckets of one table in the order of their estimated success, until it sums up to ``wanted``.

    ``chance`` has (functions, slots).  A bucket follows from another by taking, at one
    function, the next slot in the order of chances; the heap yields the best first.
    """
    functions = len(chance)
    if functions == 0:
        return [0]
    order = (-chance).argsort(1, kind="stable")
    ranked = np.take_along_axis(chance, order, 1)
    p = [[x for x in row if x > 1e-9] for row in ranked.tolist()]
    bits = [[slot << (4 * f) for slot in row] for f, row in enumerate(order.tolist())]
    top = math.prod(row[0] for row in p)
    heap, out, sum_ = [(-top, sum(row[0] for row in bits), (0,) * functions, 0)], [], 0.0
    while heap and sum_ < wanted and (most is None or len(out) < most):
        minus, bucket, ranks, from_ = heapq.heappop(heap)
        out.append(bucket)
        sum_ -= minus
        # Only functions from the last changed one on are changed, so that no bucket comes twice.
        for f in range(from_, functions):
            r = ranks[f]
            if r + 1 < len(p[f]):
                heapq.heappush(heap, (minus * p[f][r + 1] / p[f][r], bucket - bits[f][r] + bits[f][r + 1], (*ranks[:f], r + 1, *ranks[f + 1 :]), f))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, each id once, smaller ids first among equals."""
    some = np.lexsort((-scores, ids))
    some = some[np.diff(ids[some], prepend=ids[some[:1]] - 1) != 0]
    if len(some) > k:
        cut = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= cut]
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products whose value depends on the two vectors alone."""
    return (v * q).sum(1)


class Shard:
    """Vectors of some buckets of one table, sorted by bucket."""

    def __init__(self, ids: np.ndarray, buckets: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, buckets))
        self.ids, self.v = ids[order], v[order]
        self.buckets, first = np.unique(buckets[order], return_index=True)
        self.edges = [*first.tolist(), len(ids)]
        self.large = float(np.abs(v).max(initial=0.0))
        self.places = {b: n for n, b in enumerate(self.buckets.tolist())}
        self.repeats = len(np.unique(ids)) < len(ids)

    def search(self, k: int, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, visits: list[list[int]]) -> list[tuple]:
        """The k best of each query in the buckets that it visits, but its own rows."""
        found: list[list] = [[] for _ in ids]
        by_bucket: dict[int, list[int]] = {}
        for i, own in enumerate(visits):
            for bucket in own:
                by_bucket.setdefault(bucket, []).append(i)
        for bucket, who in by_bucket.items():
            n = self.places.get(bucket)
            if n is None:
                continue
            a, b = self.edges[n], self.edges[n + 1]
            rough = vectors[who] @ self.v[a:b].T
            # The matrix product may differ from the exact score in its last bits.
            slack = 1e-12 * self.v.shape[1] * self.large * np.abs(vectors[who]).max(1)
            rough[self.ids[a:b] == ids[who][:, None]] = -np.inf
            high = rough >= (floors[who] - slack)[:, None]
            if b - a > k and not self.repeats:
                high &= rough >= (np.partition(rough, b - a - k, axis=1)[:, b - a - k] - 2 * slack)[:, None]
            for row, i in enumerate(who):
                at = np.flatnonzero(high[row] & np.isfinite(rough[row])) + a
                if len(at):
                    score = exact(self.v[at], vectors[i])
                    top = best(self.ids[at], score, k)
                    found[i].append((self.ids[at][top], score[top]))
        out = []
        for i, parts in enumerate(found):
            if parts:
                own, score = (np.concatenate(x) for x in zip(*parts))
                for j in best(own, score, k).tolist():
                    out.append((int(ids[i]), int(own[j]), float(score[j])))
        return out


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, tables: int = TABLES, bucket: int = BUCKET, shard_rows: int = SHARD, seed: int = 11, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found other rows, ties to the smaller id.

    Null ids and vectors, zero vectors and those with null or non-finite components take no
    part, as row or as query.  A query meets vectors of its own length; rows with its id
    are its own.  An id repeated with several vectors counts once, with its best score; a repeated
    query row is one query, and of a query id with several vectors the smallest is asked.
    Up to ``bucket`` vectors of one length stand in one bucket and are found exactly;
    with at most k candidates all are found.  An empty table gives no rows.  Scores that
    pass what doubles hold are an error.
    """
    if k < 1 or not 0 < recall < 1:
        raise ValueError("k is at least 1 and recall between 0 and 1")
    spark = table.sparkSession
    points = usable(table, key, vector)
    size_of = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = points.groupBy("size").agg(F.count("*").alias("n"), F.max(size_of).alias("norm")).collect()
    if any(not math.isfinite(row["norm"] ** 2) for row in stats):
        raise ValueError("vectors too long for inner products in doubles")
    hashes = {row["size"]: Hashes(row["size"], max(row["n"], 1) if row["n"] > 2 * k else 1, max(row["norm"] * (1 + 1e-9), 1e-150), tables, bucket, seed) for row in stats}
    drawn: dict[int, dict] = {}
    for row in points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).collect():
        drawn.setdefault(row["size"], {})[row["id"]] = row["v"]
    samples = {size: (np.array(list(own)), np.array(list(own.values()))) for size, own in drawn.items()}
    asked = usable(queries, key, vector).filter(F.col("size").isin([row["size"] for row in stats])).groupBy("id", "size").agg(F.min("v").alias("v"))
    asked = asked.groupBy("id").agg(F.min(F.struct("size", "v")).alias("x")).select("id", "x.v", "x.size")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v in by_size(batch):
                for t, buckets in enumerate(hashes[v.shape[1]].buckets(v)):
                    names = ["id", "v", "size", "tab", "bucket"]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(np.full(len(v), t)), pa.array(buckets)], names=names)

    placed = points.mapInArrow(hashed, "id long, v array<double>, size int, tab long, bucket long")
    counts = kept(placed.groupBy("size", "tab", "bucket").count())
    large = counts.filter(F.col("count") > shard_rows).select("size", "tab", "bucket", F.ceil(F.col("count") / shard_rows).cast("long").alias("parts"))
    n_shards = max(1, sum(-(-row["n"] * hashes[row["size"]].tables // shard_rows) for row in stats))
    shard = F.pmod(F.xxhash64("size", "tab", "bucket", "part"), F.lit(n_shards))

    def build(rows: pa.Table) -> pa.Table:
        v = rows.column("v").combine_chunks().flatten().to_numpy()
        return pa.table([rows.column(c)[:1] for c in ("shard", "size", "tab")] + [
            pa.array([rows.column(c).to_numpy().tobytes()], pa.binary()) for c in ("id", "bucket")] + [pa.array([v.tobytes()], pa.binary())],
            names=["shard", "size", "tab", "ids", "buckets", "points"])

    dealt = placed.join(large, ["size", "tab", "bucket"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", F.lit(seed + 1)), "parts"), F.lit(0)))
    index = kept(dealt.withColumn("shard", shard).groupBy("shard", "size", "tab").applyInArrow(build, "shard long, size int, tab long, ids binary, buckets binary, points binary"))

    def routed(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """(size, tab, bucket) with each query that visits it."""
        for batch in batches:
            for whole, all_ in by_size(batch):
                for a in range(0, len(all_), BLOCK):
                    part, v = whole.slice(a, BLOCK), all_[a : a + BLOCK]
                    h = hashes[v.shape[1]]
                    floor = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                    guess = floor
                    if v.shape[1] in samples:
                        own, vectors = samples[v.shape[1]]
                        rough = v @ vectors.T
                        rough[own == part.column("id").to_numpy()[:, None]] = -np.inf
                        n = min(k, len(own) - 1)
                        if len(own) > k:
                            guess = np.fmax(floor, np.partition(rough, len(own) - n, axis=1)[:, len(own) - n])
                    chance = h.chances(v, np.nan_to_num(guess, nan=0.0))
                    wanted = 1 - (1 - recall) ** (1 / h.tables)
                    row, tab, bucket = [], [], []
                    for t in range(h.tables):
                        for i in range(len(v)):
                            found = probes(chance[t, i], wanted, FIRST if first else None)
                            row += [i] * len(found)
                            tab += [t] * len(found)
                            bucket += found
                    ids = part.column("id").to_numpy()[np.array(row, np.int64)]
                    out = [pa.array(np.full(len(row), v.shape[1], np.int32)), pa.array(tab, pa.int64()), pa.array(bucket, pa.int64()), pa.array(ids), pa.array(floor[np.array(row, np.int64)])]
                    yield pa.RecordBatch.from_arrays(out, names=["size", "tab", "bucket", "id", "floor"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        names = ["query_id", "vec_id", "score"]
        kinds = {"ids": np.int64, "buckets": np.int64, "points": np.float64}
        for batch in batches:
            out: list[tuple] = []
            is_index = batch.column("points").is_valid().to_numpy(zero_copy_only=False)
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("shard", "size", "tab")])
            change = np.ones(batch.num_rows, bool)
            change[1:] = (keys[1:] != keys[:-1]).any(1) | is_index[1:] | is_index[:-1]
            edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if is_index[a]:
                    ids, buckets, v = (np.frombuffer(batch.column(c)[a].as_py(), kind) for c, kind in kinds.items())
                    now, shard = tuple(keys[a]), Shard(ids, buckets, v.reshape(len(ids), -1))
                elif tuple(keys[a]) == now:  # else no vector is there
                    for c in range(a, b, BLOCK):
                        part = batch.slice(c, min(BLOCK, b - c))
                        floors = np.nan_to_num(part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                        out += shard.search(k, part.column("id").to_numpy(), matrix(part.column("v")), floors, part.column("visits").to_pylist())
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=names)

    def visited(wanted: DataFrame, first: bool) -> DataFrame:
        plan = wanted.mapInArrow(lambda b: routed(b, first), "size int, tab long, bucket long, id long, floor double")
        parts = plan.join(large, ["size", "tab", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        # One row a query and shard: the query's vector travels once to each shard that it visits.
        grouped = parts.withColumn("shard", shard).groupBy("shard", "size", "tab", "id").agg(F.max("floor").alias("floor"), F.collect_set("bucket").alias("visits"))
        rows = grouped.join(asked.select("id", "v"), "id")
        both = index.unionByName(rows, allowMissingColumns=True)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards)
        lined = both.repartition(tasks, "shard").sortWithinPartitions("shard", "size", "tab", F.col("points").isNull())
        return lined.mapInArrow(search, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = kept(merged(visited(asked.withColumn("floor", F.lit(None).cast("double")), True)))
    reached = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    second = visited(asked.join(reached, "id", "left"), False)
    ranked = merged(first.select("query_id", "vec_id", "score").unionByName(second))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
