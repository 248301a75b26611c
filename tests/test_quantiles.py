import random

import numpy as np
import pytest

from tallyfold.operators import quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(4)


@pytest.mark.parametrize("shape", ["normal", "wide", "ties", "two", "one", "sorted"])
def test_equal_to_numpy(spark, shape):
    draw = np.random.default_rng(3)
    values = {
        "normal": draw.normal(size=3001), "wide": np.exp(draw.normal(0, 60, 2000)) * draw.choice([-1, 1], 2000), "ties": draw.integers(0, 4, 2500).astype(float),
        "two": np.array([2.0] * 1500 + [5.0] * 1500), "one": np.array([7.5]), "sorted": np.arange(2500.0),
    }[shape]
    rounds = []
    got = quantiles.continuous(frame(spark, values.tolist()), "v", SHARES, most=50, accuracy=200, rounds=rounds)
    assert np.allclose(got, np.quantile(values, SHARES), rtol=1e-12, atol=0)
    assert len(rounds) <= 6


def test_many_rows_take_few_rounds(spark):
    rounds = []
    values = spark.range(2_000_000).selectExpr("cast(pmod(id * 7919, 2000003) as long) as v")
    want = np.quantile((np.arange(2_000_000) * 7919) % 2000003, [0.5, 0.99])
    assert np.allclose(quantiles.continuous(values, "v", [0.5, 0.99], rounds=rounds), want)
    assert len(rounds) <= 2 and all(n <= 2_000_000 // 200 for r in rounds[1:] for n in r.values())


def test_nulls_and_nothing(spark):
    assert quantiles.continuous(frame(spark, []), "v", [0.5]) == [None]
    assert quantiles.continuous(frame(spark, [None, None]), "v", [0.5]) == [None]
    assert quantiles.continuous(frame(spark, [None, 1.0, 3.0]), "v", [0.5]) == [2.0]
    with pytest.raises(ValueError):
        quantiles.continuous(frame(spark, [1.0]), "v", [1.5])


def test_ranks_of_whole_numbers(spark):
    draw = random.Random(5)
    values = [draw.randrange(-(10**12), 10**12) for _ in range(4000)]
    got = quantiles.at_ranks(frame(spark, values, "long"), "v", [0, 1999, 3999, 4000], most=10, accuracy=100)
    assert got == {0: sorted(values)[0], 1999: sorted(values)[1999], 3999: sorted(values)[3999]}
