"""Exact quantiles by narrowing: no task and no list holds all values.

A round asks Spark's mergeable quantile sketch for two values close around a wanted rank and counts
what lies below, at, between and at them.  The rank is then one of the two values, or lies
between them, among a few thousandths of the values.  Once at most ``most`` values are left, they are
sorted.  Two or three rounds do for any number of rows; state is of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 2000
MOST = 10_000


def at_ranks(values: DataFrame, column: str, ranks: list[int], most: int = MOST, accuracy: int = ACCURACY, rounds: list | None = None) -> dict[int, float]:
    """The values at these places, from 0, in ascending order; nulls have no place.  ``rounds`` receives what each one left open.

    ``values`` is read twice a round and should be cheap to read.  NaN is above all numbers.
    """
    x = F.col(column)
    there = values.filter(x.isNotNull()).select(x.alias("x"))
    #: Open ends of where a rank lies, how many values lie below, and how many within.
    n = there.count()
    open_ = {t: (None, None, 0, n) for t in ranks if 0 <= t < n}
    done: dict[int, float] = {}

    def within(low, high):
        test = F.lit(True)
        if low is not None:
            test = test & (F.col("x") > F.lit(low))
        return test if high is None else test & (F.col("x") < F.lit(high))

    while open_:
        small = {t for t, (_, _, _, count) in open_.items() if count <= most}
        for low, high in {open_[t][:2] for t in small}:
            found = sorted((r["x"] for r in there.filter(within(low, high)).collect()), key=lambda v: (math.isnan(v), v))
            for t in [t for t in small if open_[t][:2] == (low, high)]:
                done[t] = found[t - open_[t][2]]
        open_ = {t: w for t, w in open_.items() if t not in small}
        if not open_:
            break
        if rounds is not None:
            rounds.append({t: w[3] for t, w in open_.items()})
        asked = []
        for t, (low, high, below, count) in open_.items():
            share = (t - below + 0.5) / count
            near = [min(1.0, max(0.0, share + d * 2 / accuracy)) for d in (-1, 1)]
            asked.append(F.percentile_approx(F.when(within(low, high), F.col("x")), near, accuracy).alias(f"q{t}"))
        bounds = there.agg(*asked).first()
        counts = []
        for t, (low, high, _, _) in open_.items():
            a, b = bounds[f"q{t}"]
            test = lambda name, c: F.count_if(within(low, high) & c).alias(name)  # noqa: E731, B023
            counts += [test(f"l{t}", F.col("x") < F.lit(a)), test(f"a{t}", F.col("x") == F.lit(a)), test(f"m{t}", within(a, b)), test(f"b{t}", F.col("x") == F.lit(b))]
        seen, following = there.agg(*counts).first(), {}
        for t, (low, high, below, count) in open_.items():
            a, b = bounds[f"q{t}"]
            lower, at_a, middle, at_b = (seen[f"{c}{t}"] for c in "lamb")
            at_b = 0 if a == b else at_b
            edges = [lower, lower + at_a, lower + at_a + middle, lower + at_a + middle + at_b]
            place = t - below
            if place < edges[0]:  # the sketch was further off than it says
                following[t] = (low, a, below, edges[0])
            elif place < edges[1]:
                done[t] = a
            elif place < edges[2]:
                following[t] = (a, b, below + edges[1], middle)
            elif place < edges[3]:
                done[t] = b
            else:
                following[t] = (b, high, below + edges[3], count - edges[3])
        open_ = following
    return done


def continuous(values: DataFrame, column: str, shares: list[float], **more) -> list[float | None]:
    """Quantiles between neighbouring values in proportion (A-03); null where there is no value."""
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    n = values.filter(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    spots = [s * (n - 1) for s in shares]
    found = at_ranks(values, column, sorted({f(s) for s in spots for f in (math.floor, math.ceil)}), **more)
    return [found[math.floor(s)] + (found[math.ceil(s)] - found[math.floor(s)]) * (s - math.floor(s)) for s in spots]
