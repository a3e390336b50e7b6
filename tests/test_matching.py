"""Runs take rows in turn, against the loop that the rule is."""

import math

import numpy as np
import pytest

from sonamark.operators import matching


def loop(runs, rows):
    used, out = set(), []
    close = lambda a, b: a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    for run, k, a, b in sorted(runs):
        left = [row for row, j, c, d in rows if k is not None and j == k and row not in used and close(a, c) and close(b, d)]
        if len(left) == 1:
            used.add(left[0])
            out.append((run, left[0]))
    return out


def match(spark, runs, rows):
    r = spark.createDataFrame(runs, "run long, k string, a double, b double")
    p = spark.createDataFrame(rows, "row long, k string, a double, b double")
    return sorted(map(tuple, matching.match_in_turn(r, p, "run", "row", ["k"], ["a", "b"]).collect()))


def test_chain_of_three(spark):
    """Each take leaves the next run with one candidate."""
    v = [100 * (1 + k * 0.7e-9) for k in range(4)]
    rows = [(1, "x", v[0], 1.0), (2, "x", v[1], 1.0), (3, "x", v[3], 1.0)]
    runs = [(1, "x", v[1], 1.0), (2, "x", v[0] * (1 - 0.7e-9), 1.0), (3, "x", v[0], 1.0), (4, "x", v[2], 1.0), (5, "x", v[1], 1.0)]
    assert match(spark, runs, rows) == loop(runs, rows) == [(2, 1), (3, 2), (4, 3)]


@pytest.mark.parametrize("seed", range(2))
def test_against_loop(spark, seed):
    rng = np.random.default_rng(seed)
    some = lambda n: [(i, ["x", "y", None][int(rng.integers(0, 12)) % 5 % 3], float(rng.integers(1, 4)) * (1 + int(rng.integers(0, 4)) * 0.7e-9), None if rng.random() < 0.05 else 1.0 + float(rng.integers(0, 2))) for i in range(n)]
    runs, rows = some(120), some(30)
    got = match(spark, runs, rows)
    assert got == loop(runs, rows) and len(got) > 2


def test_equal_specs(spark):
    """Thousands of equal runs are one class: the first takes the one row, and none takes one of two."""
    rows = [(1, "x", 1.0, 1.0), (2, "y", 1.0, 1.0), (3, "y", 1.0, 1.0)]
    runs = [(i, "xy"[i % 2], 1.0, 1.0) for i in range(4000)]
    assert match(spark, runs, rows) == [(0, 1)]
    assert match(spark, runs, []) == [] and match(spark, [], rows) == []
