"""Centroid clustering against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from wiring.llm import annulus


def brute(rows, k, rounds, dim, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = {n: sum(d for _, m, d in found if m == n) for n in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sums[n], sum(sums.values()), sha[n]) for i, n, d in found), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, v int").repartition(3)


def got(spark, rows, **settings):
    return sorted(map(tuple, annulus.report(frame(spark, rows), **settings).collect()), key=str)


def f32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("grid", [False, True])
def test_equals_plain_rounds(spark, grid):
    random.seed(7)
    # on a grid of few values nearly every comparison meets ties
    rows = [(i, f32([random.choice([-1, 0, 1]) / 128 if grid else random.gauss(0, 1 + i % 5) for _ in range(3)])) for i in range(300)]
    assert got(spark, rows, k=9, rounds=4, dim=3) == brute(rows, 9, 4, 3)


def test_odd_rows(spark):
    rows = [(1, [0.5, -0.5]), (1, [0.25, 0.0]), (1, [0.25, 0.0]), (None, [9.0, 9.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 0.0]),
            (7, [float("inf"), 0.0]), (8, [-0.001, 0.001]), (9, [1.0, 2.0, 3.0]), (10, [1e5, -1e5])]
    for k in (2, 3, 40):
        assert got(spark, rows, k=k, rounds=3, dim=2) == brute(rows, k, 3, 2)
    assert got(spark, [(2, None), (3, [])], k=3, rounds=2, dim=2) == []
    assert got(spark, [], k=3, rounds=2, dim=2) == []


def test_components_too_large_for_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        got(spark, [(1, [1e30, 0.0])], k=1, rounds=1, dim=2)


def test_a_centroid_that_loses_all_vectors_stays(spark):
    rows = [(i, f32([random.Random(i).choice([0.0, 0.02, 5.0, 5.02, 9.0]), 0.0])) for i in range(60)]
    assert got(spark, rows, k=12, rounds=5, dim=2) == brute(rows, 12, 5, 2)


def test_the_annulus_leaves_comparisons_out_and_no_nearest():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-2000, 2000, (40, 8)) * np.arange(1, 41)[:, None]
    x = centroids[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, (5000, 8))
    search = annulus.Annulus(centroids)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    best, least, compared = search.nearest(x)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    again, _, fewer = search.nearest(x, best)
    assert (again == best).all() and fewer <= compared < 0.5 * every.size
    worst = every.argmax(1)  # a bound that is of no use
    assert (search.nearest(x, worst)[0] == best).all()
