"""k-means over whole-number vectors with Drake's adaptive bounds.

Each vector stores an upper bound of the distance to its centroid, lower bounds for its
``near`` next centroids, and one remainder bound for all others.  When centroids move,
every bound follows by the triangle inequality.  A vector whose upper bound lies
strictly below all lower bounds keeps its centroid; if only the remainder bound
holds, the stored centroids that may have come closer are measured exactly; else all
centroids are, and the stored ones are chosen anew.  Distances are whole numbers, so
that ties are seen, and bounds give way by ``SLACK`` for the rounding of their roots.

Vectors stand in blocks of at most ``BLOCK`` rows, which are never shuffled: a round
rewrites each block's bounds beside its sums, and only the sums of the blocks, of a size
that k and the number of components fix, are added up.  Many vectors of one kind meet
in no task, and an executor's loss costs a round's blocks alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

BLOCK = 2048
NEAR = 6
SLACK = 1e-9
#: Below this, squared distances and their parts stay within 64 bits.
LARGEST = 1 << 26

_STATE = "ids array<long>, v binary, kind string, bounds binary, sums binary"


def usable(table: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """(id, v): vectors of the wanted length without null or non-finite parts, as floor(256 x)."""
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("x").isNotNull() & (F.size("x") == components) & fine).select("id", F.transform("x", lambda x: F.floor(x * 256.0).cast("long")).alias("v"))


class Bounds:
    """What a block of n vectors knows of its distances: arrays of n rows."""

    def __init__(self, own, upper, near, lower, rest):
        self.own, self.upper, self.near, self.lower, self.rest = own, upper, near, lower, rest

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (self.own, self.near, self.upper, self.lower, self.rest))

    @classmethod
    def unpacked(cls, data: bytes, n: int) -> Bounds:
        width = (len(data) // n - 4 - 16) // 12
        own = np.frombuffer(data, np.int32, n)
        near = np.frombuffer(data, np.int32, n * width, 4 * n).reshape(n, width)
        floats = np.frombuffer(data[4 * n * (1 + width) :], np.float64)
        return cls(own.copy(), floats[:n].copy(), near.copy(), floats[n : n + n * width].reshape(n, width).copy(), floats[n + n * width :].copy())


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    most = float(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if vectors.shape[1] * (2 * most) ** 2 < 2**52 else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)


def squared_own(vectors: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to one centroid."""
    gap = vectors.astype(np.int64) - centroids[own]
    return (gap * gap).sum(1)


def scanned(vectors: np.ndarray, centroids: np.ndarray, near: int) -> Bounds:
    """Bounds from all distances; the smaller number wins a tie."""
    n, k = len(vectors), len(centroids)
    near = max(0, min(near, k - 1))
    d = squared(vectors, centroids)
    own = d.argmin(1)
    rows = np.arange(n)
    roots = np.sqrt(d.astype(np.float64))
    upper = roots[rows, own]
    roots[rows, own] = np.inf
    if near + 1 < k:
        order = np.argpartition(roots, near, axis=1)[:, : near + 1]
        value = np.take_along_axis(roots, order, 1)
        sort = value.argsort(1)
        order, value = np.take_along_axis(order, sort, 1), np.take_along_axis(value, sort, 1)
        return Bounds(own.astype(np.int32), upper, order[:, :near].astype(np.int32), value[:, :near], value[:, near].copy())
    order = roots.argsort(1)[:, :near]
    return Bounds(own.astype(np.int32), upper, order.astype(np.int32), np.take_along_axis(roots, order, 1), np.full(n, np.inf))


def moved(b: Bounds, vectors: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[Bounds, int]:
    """Bounds after the centroids moved by ``drift``, and how many vectors met all centroids again."""
    rows = np.arange(len(b.own))
    b.upper += drift[b.own] + SLACK * (1 + b.upper)
    b.lower -= drift[b.near] + SLACK * (1 + b.lower)
    b.rest -= drift.max(initial=0.0) + SLACK * (1 + np.where(np.isfinite(b.rest), b.rest, 0))
    least = np.minimum(b.lower.min(1, initial=np.inf), b.rest)
    open_ = rows[~(b.upper < least)]
    if len(open_):  # first the own distance is measured
        b.upper[open_] = np.sqrt(squared_own(vectors[open_], centroids, b.own[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(b.upper[open_] < least[open_])]
    few = open_[b.upper[open_] < b.rest[open_]]
    far = open_[~(b.upper[open_] < b.rest[open_])]
    if len(few):
        # Stored centroids whose bound does not keep them away are measured.
        row, slot = np.nonzero(~(b.lower[few] > b.upper[few][:, None]))
        at, centroid = few[row], b.near[few[row], slot]
        exact = squared_own(vectors[at], centroids, centroid)
        b.lower[at, slot] = np.sqrt(exact.astype(np.float64)) * (1 - SLACK)
        order = np.lexsort((centroid, exact, row))
        best = order[np.unique(row[order], return_index=True)[1]]  # the nearest stored one of each row
        own = squared_own(vectors[at[best]], centroids, b.own[at[best]])
        best = best[(exact[best] < own) | (exact[best] == own) & (centroid[best] < b.own[at[best]])]
        rows = at[best]
        before, upper = b.own[rows].copy(), b.upper[rows] * (1 - 3 * SLACK)
        b.own[rows], b.upper[rows] = centroid[best], np.sqrt(exact[best].astype(np.float64)) * (1 + SLACK)
        b.near[rows, slot[best]], b.lower[rows, slot[best]] = before, upper
    if len(far):
        new = scanned(vectors[far], centroids, b.near.shape[1])
        b.own[far], b.upper[far], b.near[far], b.lower[far], b.rest[far] = new.own, new.upper, new.near, new.lower, new.rest
    return b, len(far)


def _sums(vectors: np.ndarray, own: np.ndarray, centroids: np.ndarray, rescanned: int) -> np.ndarray:
    """(k + 1, components + 2): sums, counts and inertia of a block's clusters; last, the rows met again."""
    k, width = centroids.shape
    out = np.zeros((k + 1, width + 2), np.int64)
    order = own.argsort(kind="stable")
    there, first = np.unique(own[order], return_index=True)
    if len(there):
        out[there, :width] = np.add.reduceat(vectors[order].astype(np.int64), first, axis=0)
        out[:k, width] = np.bincount(own, minlength=k)
        out[there, width + 1] = np.add.reduceat(squared_own(vectors, centroids, own)[order], first)
    out[k, 0] = rescanned
    return out


def _blocks(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            if held and n + part.num_rows > BLOCK:
                yield _block(held, components)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield _block(held, components)


def _block(parts: list[pa.RecordBatch], components: int) -> tuple[pa.Array, np.ndarray]:
    rows = pa.Table.from_batches(parts).combine_chunks()
    v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, components)
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)))
    if most >= LARGEST:
        raise ValueError("components too large for squared distances of 64 bits")
    return rows.column("id").combine_chunks(), v.astype(np.int16 if most < 1 << 15 else np.int32)


def _row(ids: pa.Array, v: bytes, kind: str, bounds: Bounds, sums: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [lists, pa.array([v], pa.binary()), pa.array([kind]), pa.array([bounds.packed()], pa.binary()), pa.array([sums.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "v", "kind", "bounds", "sums"])


def _written(state: DataFrame) -> tuple[str, DataFrame]:
    path = f"{shared.folder(state.sparkSession)}/drake-{uuid.uuid4().hex}"
    state.write.parquet(path)
    return path, state.sparkSession.read.schema(_STATE).parquet(path)


def _added(state: DataFrame, k: int, components: int) -> np.ndarray:
    """The sums of all blocks."""
    size = (k + 1) * (components + 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "n"])

    rows = state.select("sums").mapInArrow(add, "place long, n long").groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = np.zeros(size, object)
    for row in rows:
        out[row["place"]] = int(row["n"])
    return out.reshape(k + 1, components + 2)


def cluster(
    table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, components: int = 64, near: int = NEAR, key: str = "vec_id", vector: str = "embedding", report: list | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row a kept vector.

    Vectors that are null, of another length, or hold null or non-finite components take no
    part.  A null id may be clustered but never starts a centroid; repeated ids are rows of
    their own, and of equal hashes the smaller vector starts first.  With fewer than k
    vectors there are as many centroids; an empty table gives no rows.  Components of
    2**26 and more after scaling are an error.  ``report`` receives, for each
    assignment, how many vectors met all centroids.
    """
    if k < 1 or rounds < 0 or near < 0:
        raise ValueError("k is at least 1, rounds and near are not negative")
    spark = table.sparkSession
    points = usable(table, key, vector, components)
    hashed = points.filter("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    first = [row["v"] for row in hashed.orderBy("h", "v").limit(k).select("v").collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array(first, np.int64)
    if np.abs(centroids).max() >= LARGEST:
        raise ValueError("components too large for squared distances of 64 bits")

    def start(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for ids, v in _blocks(batches, components):
            bounds = scanned(v, c, near)
            yield _row(ids, v.tobytes(), v.dtype.str, bounds, _sums(v, bounds.own, c, len(v)))

    def again(batches: Iterator[pa.RecordBatch], c: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, data, kind = batch.column("ids")[i].values, batch.column("v")[i].as_py(), batch.column("kind")[i].as_py()
                v = np.frombuffer(data, kind).reshape(-1, components)
                bounds, far = moved(Bounds.unpacked(batch.column("bounds")[i].as_py(), len(v)), v, c, drift)
                yield _row(ids, data, kind, bounds, _sums(v, bounds.own, c, far))

    count = len(centroids)
    path, state = _written(points.mapInArrow(lambda b, c=centroids: start(b, c), _STATE))
    total = _added(state, count, components)
    for _ in range(rounds):
        if report is not None:
            report.append(total[count, 0])
        new = np.array([[x // t[components] for x in t[:components]] if t[components] else c for t, c in zip(total[:count].tolist(), centroids.tolist())], np.int64)
        gap = (new - centroids).astype(np.float64)
        drift, centroids = np.sqrt((gap * gap).sum(1)) * (1 + SLACK), new
        before = path
        path, state = _written(state.mapInArrow(lambda b, c=centroids, d=drift: again(b, c, d), _STATE))
        shared.delete(spark, before)
        total = _added(state, count, components)
    if report is not None:
        report.append(total[count, 0])
    inertia = [int(x) for x in total[:count, components + 1]]
    if sum(inertia) >= 2**63:
        raise ValueError("the inertia passes 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_cluster, names = np.array(inertia, np.int64), pa.array(digests)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                v = np.frombuffer(batch.column("v")[i].as_py(), batch.column("kind")[i].as_py()).reshape(-1, components)
                own = Bounds.unpacked(batch.column("bounds")[i].as_py(), len(v)).own
                columns = [ids, pa.array(own), pa.array(squared_own(v, centroids, own)), pa.array(per_cluster[own]), pa.array(np.full(len(v), sum(inertia))), names.take(pa.array(own))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return state.mapInArrow(out, schema)
