import math
import random

import numpy as np
import pytest

from tallyfold.llm import multiprobe

SCHEMA = "vec_id long, embedding array<double>, score string, id int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(parts)


def plain(rows, asked, k):
    """Best rows of each query by plain inner products, each id once."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = [(i, v) for i, v in rows if i is not None and fine(v)]
    out = {}
    for q, v in kept:
        if q in asked and q not in out:
            scores = {}
            for i, w in kept:
                if i != q and len(w) == len(v):
                    scores[i] = max(scores.get(i, -math.inf), sum(a * b for a, b in zip(v, w)))
            out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(table, asked, k, **more):
    out = {}
    for r in multiprobe.nearest(table, table.filter(table.vec_id.isin(list(asked))), k=k, **more).orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def gauss(n, size, seed, norm=True):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, size))
    if norm:
        v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, x) for i, x in enumerate(v.tolist())]


def recall(rows, asked, k, got):
    want = plain(rows, asked, k)
    hits = sum(sum(s >= want[q][-1][1] - 1e-12 for _, s in got.get(q, [])) for q in want)
    assert all(len(got[q]) == len(want[q]) for q in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("norm", [True, False])
def test_recall_on_unstructured_vectors(spark, norm):
    rows, asked = gauss(1500, 12, 1, norm), set(range(0, 1500, 50))
    got = found(frame(spark, rows), asked, 10, bucket=32, shard_rows=200)
    assert recall(rows, asked, 10, got) >= 0.9


def test_recall_on_a_hot_group(spark):
    rows, draw = gauss(900, 16, 2), np.random.default_rng(3)
    middle = np.array(rows[0][1])
    rows += [(1000 + i, (middle + draw.normal(0, 0.01, 16)).tolist()) for i in range(450)]
    asked = {*range(0, 900, 90), *range(1000, 1450, 30)}
    got = found(frame(spark, rows), asked, 10, bucket=32, shard_rows=100)
    assert recall(rows, asked, 10, got) >= 0.9


def test_small_tables_are_exact(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5]) for _ in range(5)]) for i in range(120)]
    rows += [(None, [1.0] * 5), (200, None), (201, []), (202, [0.0] * 5), (203, [1.0, None, 0.0, 0.0, 0.0]), (204, [math.nan] * 5), (205, [math.inf] * 5)]
    rows += [(210, [1.0, 2.0]), (211, [2.0, 1.0]), (3, rows[3][1]), (5, [0.25] * 5), (212, [1.0, 1.0, 1.0])]
    asked = {0, 3, 20, 40, 210, 211, 212}
    assert found(frame(spark, rows), asked, 20) == {q: x for q, x in plain(rows, asked, 20).items() if x}


def test_few_candidates_and_empty(spark):
    rows = gauss(9, 4, 5)
    got = found(frame(spark, rows), {0, 1}, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in plain(rows, {0, 1}, 20).items()}
    assert found(frame(spark, []), {0}, 3) == {}
    with pytest.raises(ValueError):
        multiprobe.nearest(frame(spark, rows), frame(spark, rows), k=0)


def test_probes_come_in_order_of_chance():
    draw = np.random.default_rng(6)
    chance = draw.dirichlet(np.ones(5), 4)
    all_ = {}
    for place in np.ndindex(5, 5, 5, 5):
        all_[sum(s << (4 * f) for f, s in enumerate(place))] = math.prod(chance[f, s] for f, s in enumerate(place))
    order = multiprobe.probes(chance, 0.9)
    assert len(set(order)) == len(order)
    assert np.allclose([all_[b] for b in order], sorted(all_.values(), reverse=True)[: len(order)])
    assert sum(all_[b] for b in order[:-1]) < 0.9 <= sum(all_[b] for b in order) + 1e-12
