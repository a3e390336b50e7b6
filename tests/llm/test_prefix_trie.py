"""The prefix trie against one built in plain Python, with heavy nodes, spilled messages, ties, nulls and turnless conversations."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonamark.llm import prefix_trie


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest(k)) for k, m in members.items())


def got(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("x"), "parent": F.lit(1), "conv": F.lit("y"), "d": F.lit(2)})
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df, **sizes).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for c in map(int, rng.permutation(np.arange(-12, 60))):
        for t in range(int(rng.integers(0, 14))):
            out.append((c, t, ["user", "assistant"][t % 2], f"text ü {int(rng.integers(0, 2))}" if t < 4 else f"{int(rng.integers(0, 3))}"))
    for c in range(100, 130):  # a large group of copies
        out += [(c, t, "user", f"same {t}") for t in range(9)]
    out += [(200, t, "user", f"long {t}") for t in range(400)]  # a conversation with many turns
    out += [(201, None, None, None), (201, 1, "a", "tie"), (201, 1, "a", "tie"), (201, 1, "b", "tie"), (201, -3, "", "x" * 100_000), (None, 1, "user", "no id"), (202, 0, "user", "long 0")]
    return out


@pytest.mark.parametrize("sizes", [{}, {"fit": 7, "most": 5}, {"fit": 60, "most": 1}])
def test_against_plain(spark, rows, sizes):
    assert got(spark, rows, **sizes) == plain(rows)


def test_small(spark):
    assert got(spark, []) == []
    one = [(3, 0, "user", "a")]
    assert got(spark, one) == plain(one)
    assert got(spark, [(None, 0, "user", "a")]) == []


def test_messages_in_order():
    queue, want = prefix_trie.Messages(3), Counter()
    rng = np.random.default_rng(2)
    for depth in (9, 8, 7):
        for _ in range(40):
            key = bytes([int(rng.integers(0, 5))] * 16)
            queue.push(depth, key, 1, 2, 3)
            want[depth, key] += 1
    for (depth, key), n in sorted(want.items(), key=lambda x: (-x[0][0], x[0][1])):
        assert queue.take(depth, key) == (n, 2 * n, 3 * n)
    assert not len(queue)


def test_running_sums_over_ranges(spark):
    """A group that lies in many ranges goes on where the range before it ended."""
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("g"), (F.col("id") * 7919 % 4001).alias("o"), (F.col("id") % 11).alias("v"))
    from pyspark.sql import Window as W

    w = W.partitionBy("g").orderBy("o")
    want = rows.select("g", "o", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(w).alias("v"))
    out = prefix_trie.in_order(rows, "g", ["o"], "n", ["v"]).select("g", "o", "n", "v")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
