"""Ranked search against scores of every pair, over trees small enough to prune, blocks of items, ties, nulls and repeated rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonamark.llm import ball_tree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k):
    words = lambda t: TERM.findall((t or "").translate(LOWER))
    own = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in own:
            m = 100 - 25 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "été", "日本", "x1y", "İ", "a_b", "it's"]
    share = 1 / np.arange(1, len(words) + 1)
    say = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, say(int(rng.integers(1, 50)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, " .,;\n"), (2003, "w1 " * 50_000), (None, docs[3][1]), (None, docs[4][1]), (5, docs[5][1]), (5, docs[5][1])]
    items = [(i, say(int(rng.integers(1, 20)))) for i in range(25)] + [(50, None), (51, "..."), (52, "unheard of"), (None, "w1 w1 w2"), (53, docs[7][1]), (53, docs[7][1]), (54, "w0 " * 2000)]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"k": 3, "leaf": 2, "most": 40, "block_terms": 30, "probes": 1}])
def test_against_all_pairs(spark, tables, sizes):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "id": F.lit(1), "q": F.lit(2)}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(0), "doc_id": F.lit(0)})
    got = ball_tree.ranked(d, i, **sizes).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items, sizes.get("k", 20))


def test_empty(spark, tables):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_tree.ranked(docs.limit(0), items).count() == 0
    assert ball_tree.ranked(docs, items.limit(0)).count() == 0
    assert ball_tree.ranked(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold():
    """No score below a node passes its bound, and a search leaves out part of the leaves."""
    rng = np.random.default_rng(4)
    n, terms = 600, 80
    rows = [np.sort(rng.choice(terms // 4, int(rng.integers(1, 6)), replace=False) + terms // 4 * (i % 4)) for i in range(n)]
    ptr = np.append(0, np.cumsum([len(r) for r in rows]))
    weights = rng.integers(1, 9000, terms)
    tree = ball_tree.BallTree.grown(np.arange(n), np.zeros(n, bool), ptr, np.concatenate(rows), rng.integers(1, 900_000, ptr[-1]), weights, 8)
    tree = ball_tree.BallTree.unpacked(tree.packed(), weights)
    plane, tops, visited = tree.plane(), tree.tops(), 0
    for _ in range(50):
        asked, counts = np.sort(rng.choice(terms, 5, replace=False)), rng.integers(1, 4, 5)
        q = np.zeros(terms, np.int64)
        q[asked] = counts * weights[asked]
        scores = np.add.reduceat(q[tree.idx] * tree.val, tree.ptr[:-1])
        bounds = tree.bounds(plane, tops, asked, counts)
        assert all(scores[a:b].max() <= u for a, b, u in zip(tree.lo, tree.hi, bounds))
        got = tree.best(plane, tops, asked, counts, 10, 1, np.zeros(terms, np.int64))
        visited += (bounds[tree.left < 0] >= min(s for s, _, _ in got)).sum()
        want = sorted(zip(scores.tolist(), (-tree.ids).tolist()), reverse=True)[:10]
        assert sorted(got, key=lambda r: (-r[0], r[2])) == [(s, False, -i) for s, i in want if s > 0]
    assert visited < 50 * (tree.left < 0).sum() / 2
