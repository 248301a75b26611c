import hashlib
import math
import random

import numpy as np
import pytest

from tallyfold.llm import drake

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def plain(rows, k, rounds, components):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in starts[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(far(v)[1], []).append(v)
        for j, own in groups.items():
            c[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *far(v)) for i, v in kept]
    per = {j: sum(d for _, d, o in out if o == j) for _, _, j in out}
    return sorted(repr((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())) for i, d, j in out)


def got(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def clustered(n, components, seed, scale=1.0):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, scale) for _ in range(components)] for _ in range(7)]
    return [(i, [draw.gauss(m, 0.15 * scale) for m in middles[i % 7]]) for i in range(n)]


@pytest.mark.parametrize("near", [0, 1, 3, 30])
@pytest.mark.parametrize("scale", [0.01, 1.0, 9e4])
def test_equals_plain_rounds(spark, near, scale):
    rows = clustered(240, 6, 1, scale)
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(3)
    assert got(drake.cluster(table, 12, 4, components=6, near=near)) == plain(rows, 12, 4, 6)


def test_irregular_rows(spark):
    rows = clustered(40, 4, 2) + [(None, None), (50, None), (51, []), (52, [1.0]), (53, [1.0, None, 0.0, 0.0]), (54, [math.nan] * 4), (55, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (7, [0.0] * 4), (60, [0.0] * 4), (61, [0.0] * 4), (3, clustered(40, 4, 2)[3][1])]
    table = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    assert got(drake.cluster(table, 9, 3, components=4)) == plain(rows, 9, 3, 4)


def test_ties_copies_and_few_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)]
    table = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    assert got(drake.cluster(table, 10, 3, components=2)) == plain(rows, 10, 3, 2)
    few = spark.createDataFrame([(1, [0.0, 1.0], 0, ""), (2, [5.0, 1.0], 0, "")], SCHEMA)
    assert got(drake.cluster(few, 40, 5, components=2)) == plain([(1, [0.0, 1.0]), (2, [5.0, 1.0])], 40, 5, 2)


def test_empty_and_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drake.cluster(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert drake.cluster(empty).count() == 0
    with pytest.raises(ValueError):
        drake.cluster(spark.createDataFrame([(1, [1e9, 0.0], 0, "")], SCHEMA), components=2)
    with pytest.raises(ValueError):
        drake.cluster(empty, k=0)


def test_bounds_save_scans(spark):
    rows, report = clustered(3000, 8, 3), []
    table = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    drake.cluster(table, 20, 5, components=8, report=report).count()
    assert report[0] == 3000 and sum(report[1:]) < 3000


def test_bounds_hold():
    draw = np.random.default_rng(4)
    v, c = draw.integers(-300, 300, (400, 5)), draw.integers(-300, 300, (15, 5))
    b = drake.scanned(v, c, 4)
    for _ in range(6):
        new = c + draw.integers(-40, 40, c.shape)
        gap = (new - c).astype(float)
        b, _ = drake.moved(b, v, new, np.sqrt((gap * gap).sum(1)) * (1 + drake.SLACK))
        c, d = new, drake.squared(v, new)
        assert (d.argmin(1) == b.own).all()
        roots = np.sqrt(d.astype(float))
        assert (b.lower <= np.take_along_axis(roots, b.near, 1) + 1e-6).all()
        roots[np.arange(400), b.own] = np.inf
        np.put_along_axis(roots, b.near, np.inf, 1)
        assert (b.rest <= roots.min(1) + 1e-6).all()
