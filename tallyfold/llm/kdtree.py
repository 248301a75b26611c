"""Exact top-k search by inner product: a KD-tree for each shard of the vectors.

Shards are themselves cells of median splits, which are fitted on a bounded sample
(``SAMPLE`` vectors, at most ``CELLS`` cells); a cell that holds more than a shard's rows
is dealt out to several shards by hash.  Every vector is in one shard.  A shard's tree
splits at medians of the widest dimension of the tight box around its points, down to
small leaves, and is built once: points and boxes are one row.  Traversal is best first:
a box bounds the inner product with a query by taking, in each dimension, the corner
that the query likes best, and no box below the kth best score is opened.

A query first searches one shard of the cell with the best bound.  The kth score found
there goes with it to the shards of those cells alone whose tight boxes can reach it.
A task opens a shard's tree and streams the shard's queries past it, so that neither
trees nor vectors are copied and no group of queries stands in memory.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

LEAF = 64
SHARD_ROWS = 8192
#: Vectors from which the cells are fitted, and the most cells; each takes 16 of them at least.
SAMPLE, CELLS = 8192, 512
SLICE = 256


class Tree:
    """Flat arrays of a KD-tree: points in leaf order, and nodes with boxes and ranges."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.first, self.last, self.children = [], [], []
        lows, highs = [], []
        place = np.arange(len(ids))
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.first)
            own = self.points[place[a:b]]
            low, high = own.min(0), own.max(0)
            self.first.append(a)
            self.last.append(b)
            self.children.append([])
            lows.append(low)
            highs.append(high)
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > LEAF and (high > low).any():
                axis = int((high - low).argmax())
                middle = (b - a) // 2
                place[a:b] = place[a:b][np.argpartition(own[:, axis], middle)]
                todo += [(a + middle, b, node), (a, a + middle, node)]
        self.ids, self.points = self.ids[place], self.points[place]
        self.low, self.high = np.array(lows), np.array(highs)

    def search(self, query: int, vector: np.ndarray, k: int, floor: float, bounds: np.ndarray) -> list[tuple[int, int]]:
        """At most k (score, -id) that may be among the best k: none below ``floor``."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor or len(best) == k and -bound < best[0][0]:
                break
            for child in self.children[node]:
                heapq.heappush(heap, (-bounds[child], child))
            if self.children[node]:
                continue
            a, b = self.first[node], self.last[node]
            scores = self.points[a:b] @ vector
            for i in np.flatnonzero(scores >= max(floor, best[0][0] if len(best) == k else floor)).tolist():
                if self.ids[a + i] != query:
                    item = (int(scores[i]), -int(self.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        return best

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """(queries, nodes) upper bounds of inner products."""
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        return up @ self.high.T + down @ self.low.T


def _matrix(column) -> np.ndarray:
    """Rows of whole numbers, in floats where every inner product stays exact in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = flat.reshape(len(column), -1)
    return out.astype(np.float64) if _is_small(out) else out


def _is_small(x: np.ndarray) -> bool:
    return x.size == 0 or x.shape[1] * float(np.abs(x.astype(np.float64)).max()) ** 2 < 2**52


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, size): vectors as whole numbers floor(256 x), but those with null or non-finite parts."""
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("x"))
    whole = F.transform("x", lambda x: F.floor(x * 256.0).cast("long"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine).select("id", whole.alias("v"), F.size("x").alias("size"))


class Cells:
    """Cells of median splits, for each length of vector, and the shards that each cell has."""

    def __init__(self, sizes: dict[int, int], sample: list[list[int]], shard_rows: int):
        self.splits: dict[int, list[tuple]] = {}
        self.of_size: dict[int, list[int]] = {}
        self.first, self.shards = [], []
        by_size: dict[int, list[list[int]]] = {}
        for v in sample:
            by_size.setdefault(len(v), []).append(v)
        for size, n in sorted(sizes.items()):
            drawn = np.array(by_size.get(size, []), np.float64).reshape(-1, size)
            wanted = max(1, min(-(-n // shard_rows), CELLS * len(drawn) // SAMPLE, len(drawn) // 16))
            # A split is (axis, cut, left, right); a negative side is the cell -1 - side.
            nodes: list[tuple] = []
            self.splits[size], self.of_size[size] = nodes, []

            def grow(own: np.ndarray, cells: int) -> int:
                spread = own.max(0) - own.min(0) if len(own) else np.zeros(size)
                axis = int(spread.argmax())
                if cells > 1 and spread[axis] > 0:
                    cut = np.quantile(own[:, axis], cells // 2 / cells)
                    left = own[:, axis] < cut
                    if left.any() and not left.all():
                        spot = len(nodes)
                        nodes.append(())
                        nodes[spot] = (axis, cut, grow(own[left], cells // 2), grow(own[~left], cells - cells // 2))
                        return spot
                cell = len(self.first)
                self.of_size[size].append(cell)
                self.first.append(self.first[-1] + self.shards[-1] if self.first else 0)
                self.shards.append(max(1, round(n * len(own) / max(1, len(drawn)) / shard_rows)) if len(drawn) else -(-n // shard_rows))
                return -1 - cell

            grow(drawn, wanted)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        nodes = self.splits[vectors.shape[1]]
        out = np.zeros(len(vectors), np.int64)
        todo = [(0 if nodes else -1 - self.of_size[vectors.shape[1]][0], np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, cut, left, right = nodes[node]
            below = vectors[rows, axis] < cut
            todo += [(left, rows[below]), (right, rows[~below])]
        return out


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with vectors of one length, and their matrix."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        part = batch.filter(pa.array(sizes == size))
        yield part, _matrix(part.column("v"))


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0.0))


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller id.

    A query meets vectors of its own length only; rows with the query's id are its own.
    Ids repeated with other vectors count as further candidates; a query row repeated
    is one query.  Fewer than k candidates give fewer rows, none give none.  Components
    so large that a score could pass 64 bits are an error.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    points = usable(table, key, vector)
    sizes = {row["size"]: row["n"] for row in points.groupBy("size").agg(F.count("*").alias("n")).collect()}
    asked = usable(queries, key, vector).distinct().filter(F.col("size").isin(list(sizes)))
    sample = points.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).select("v").collect()
    cells = Cells(sizes, [row["v"] for row in sample], shard_rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shards = np.array(cells.first), np.array(cells.shards)
        for batch in batches:
            for part, vectors in _by_size(batch):
                cell = cells.assign(vectors)
                shard = first[cell] + part.column("salt").to_numpy() % shards[cell]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cell), pa.array(shard)], names=["id", "v", "cell", "shard"])

    def build(rows: pa.Table) -> pa.Table:
        tree = Tree(rows.column("id").to_numpy(), _matrix(rows.column("v")))
        box = [pa.array([x[0].astype(np.float64)], pa.list_(pa.float64())) for x in (tree.low, tree.high)]
        return pa.table([rows.column("cell")[:1], rows.column("shard")[:1], pa.array([pickle.dumps(tree)], pa.binary()), *box], names=["cell", "shard", "tree", "low", "high"])

    salted = points.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)))
    placed = salted.mapInArrow(assign, "id long, v array<long>, cell long, shard long")
    trees = kept(placed.groupBy("shard").applyInArrow(build, "cell long, shard long, tree binary, low array<double>, high array<double>"))
    corners = trees.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "box")).groupBy("cell", "axis").agg(F.min("box.low").alias("low"), F.max("box.high").alias("high"))
    boxes: dict[int, list[tuple[int, float, float]]] = {}
    for row in corners.collect():  # CELLS tight boxes at most for each length
        boxes.setdefault(row["cell"], []).append((row["axis"], row["low"], row["high"]))
    tight = {cell: np.array(sorted(own))[:, 1:].T for cell, own in boxes.items()}

    def bounds(vectors: np.ndarray, own: list[int]) -> np.ndarray:
        """Upper bounds, a little above what rounding may take away."""
        v = vectors.astype(np.float64)
        low, high = (np.array([tight[c][i] for c in own]) for i in (0, 1))
        return np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T + 1e-9 * (np.abs(v) @ np.maximum(np.abs(low), np.abs(high)).T)

    def route(batches: Iterator[pa.RecordBatch], everywhere: bool) -> Iterator[pa.RecordBatch]:
        first, shards = np.array(cells.first), np.array(cells.shards)
        for batch in batches:
            for part, vectors in _by_size(batch):
                own = [c for c in cells.of_size[vectors.shape[1]] if c in tight]
                for a in range(0, len(vectors), SLICE):
                    some = part.slice(a, SLICE)
                    bound = bounds(vectors[a : a + SLICE], own)
                    best = np.array(own)[bound.argmax(1)]
                    home = first[best] + some.column("salt").to_numpy() % shards[best]
                    if everywhere:
                        floor = some.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                        row, cell = np.nonzero(bound >= (floor - 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0)))[:, None])
                        cell = np.array(own)[cell]
                        n = shards[cell]
                        row, turn = np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        shard = np.repeat(first[cell], n) + turn
                        other = shard != home[row]
                        row, shard = row[other], shard[other]
                    else:
                        row, shard = np.arange(len(home)), home
                    for b in range(0, len(row), 16 * SLICE):
                        out = some.take(pa.array(row[b : b + 16 * SLICE]))
                        yield pa.RecordBatch.from_arrays([pa.array(shard[b : b + 16 * SLICE]), out.column("id"), out.column("v"), out.column("floor")], names=["shard", "id", "v", "floor"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            is_tree = batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shards, prepend=shards[:1] - 1) != 0) | is_tree | np.concatenate([[False], is_tree[:-1]])) if len(shards) else []
            for a, b in zip(edges, [*edges[1:], len(shards)]):
                if is_tree[a]:
                    now, tree = shards[a], pickle.loads(batch.column("tree")[int(a)].as_py())
                    continue
                if shards[a] != now:
                    continue  # a shard that holds no vector
                part = batch.slice(a, b - a)
                vectors = _matrix(part.column("v"))
                if vectors.shape[1] * _largest(tree.points) * _largest(vectors) >= 2**62:
                    raise ValueError("components too large for scores of 64 bits")
                if tree.points.dtype != vectors.dtype:
                    vectors = vectors.astype(np.int64)
                    tree.points, tree.low, tree.high = (x.astype(np.int64) for x in (tree.points, tree.low, tree.high))
                ids, out = part.column("id").to_pylist(), []
                floors = [-np.inf if x is None else x for x in part.column("floor").to_pylist()]
                for i in range(0, len(ids), SLICE):
                    bound = tree.bounds(vectors[i : i + SLICE])
                    for j in range(i, min(i + SLICE, len(ids))):
                        out += [(ids[j], -n, s) for s, n in tree.search(ids[j], vectors[j], k, floors[j], bound[j - i])]
                columns = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    def found(wanted: DataFrame, everywhere: bool) -> DataFrame:
        routed = wanted.mapInArrow(lambda b: route(b, everywhere), "shard long, id long, v array<long>, floor long")
        both = trees.select("shard", "tree").unionByName(routed, allowMissingColumns=True)
        # A few shards a task, so that few trees come in one Arrow batch.
        tasks = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(cells.shards) // 4)
        lined = both.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("tree").isNull())
        return lined.mapInArrow(search, "query_id long, vec_id long, score long")

    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)))
    first = kept(found(asked.withColumn("floor", F.lit(None).cast("long")), False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select(F.col("query_id").alias("q"), F.col("score").alias("floor"))
    second = found(asked.join(reached, asked["id"] == reached["q"], "left").drop("q"), True)
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
