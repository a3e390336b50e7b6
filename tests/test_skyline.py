"""Skylines against all pairs; pieces that can't dominate each other don't meet."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonamark.operators import ranking


def brute(p):
    p = np.unique(p, axis=0)
    return p[[((p <= x).all(1)).sum() == 1 for x in p]] if len(p) else p


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_skyline(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, 70, 700):
        for values in (2, 12, 1000):
            p = rng.integers(0, values, (n, k)).astype(float)
            assert np.array_equal(ranking.skyline(p), brute(p))
            a, b = p[: n // 3], p[n // 3 :]
            assert ranking.beaten(a, b).tolist() == [bool((a <= x).all(1).any()) for x in b]


def test_many_points_that_nothing_dominates():
    x = np.random.default_rng(0).random((300_000, 3))
    x /= x.sum(1, keepdims=True)
    began = time.time()
    assert len(ranking.skyline(x)) == 300_000 and time.time() - began < 60


@pytest.mark.parametrize("group", [[], ["g"]])
def test_pieces_in_z_order(spark, group):
    """Frontiers that don't fit are cut; on a slanted plane most pieces need not meet."""
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    x /= x.sum(1, keepdims=True)
    x[::7] += 0.05
    rows = spark.createDataFrame([(i, "a" if i % 3 else None, *map(float, p)) for i, p in enumerate(x)], "run int, g string, x double, y double, z double")
    got = {r.run for r in ranking.frontier(rows, {"x": "min", "y": "min", "z": "min"}, group, fit=200).collect()}
    want = set()
    for part in [np.flatnonzero(np.arange(4000) % 3 == 0), np.flatnonzero(np.arange(4000) % 3)] if group else [np.arange(4000)]:
        own = {tuple(p) for p in brute(x[part])}
        want |= {int(i) for i in part if tuple(x[i]) in own}
    assert got == want
    points = rows.select(*group, *(F.col(c).alias(f"_{k}") for k, c in enumerate("xyz")))
    cols = ["_0", "_1", "_2"]
    cut = points.withColumn("_z", ranking.z_order(points, cols)).repartitionByRange(96, *group, "_z").withColumn("_piece", F.spark_partition_id())
    box = [(r[: len(group)], np.array(r[len(group) + 1 :])) for r in ranking.corners(cut, group, cols).collect()]
    meet = sum(g == h and bool((b[:3] <= a[3:]).all()) for g, a in box for h, b in box)
    assert meet < 0.6 * sum(g == h for g, _ in box for h, _ in box)
