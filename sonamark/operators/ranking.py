"""Ranks, ties within error, and Pareto frontiers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.levels import indistinguishable
from ..sources.store import kept
from .offsets import numbered, running, same


def signed(column: str, better: str):
    return F.col(column) if better == "min" else -F.col(column)


def rank_order(rows: DataFrame, group: list[str], column: str, run_id: str, better: str = "min") -> DataFrame:
    """rows that have a value, with rank (best first, ties by id) and field size, within each group. A group's rows are counted range by range."""
    x = rows.where(F.col(column).isNotNull()).withColumn("_v", signed(column, better))
    ranked = numbered(x, "_v", "rank", tie=run_id, group=group)
    return same(ranked, x.groupBy(*group).agg(F.count("*").alias("field")), group).drop("_v")


def leader_ties(rows: DataFrame, group: list[str], column: str, sem: str, run_id: str, better: str = "min") -> DataFrame:
    """For each group: rows tied with the first, and the last position of such a row. Aggregates only: no row is ranked."""
    x = rows.where(F.col(column).isNotNull()).select(*group, F.struct(signed(column, better).alias("v"), F.col(run_id).alias("id")).alias("_at"), F.col(column).alias("_value"), F.col(sem).alias("_sem"))
    lead = x.groupBy(*group).agg(F.min(F.struct("_at", F.col("_value").alias("v"), F.col("_sem").alias("s"))).alias("_lead"))
    both = same(x, lead, group)
    tied = indistinguishable("_value", "_sem", F.col("_lead.v"), F.col("_lead.s"), zero_sem_is_null=True) | (F.col("_at") == F.col("_lead._at"))
    worst = both.groupBy(*group).agg(F.count_if(tied).alias("tied"), F.max(F.when(tied, F.col("_at"))).alias("_worst"))
    return same(x, worst, group).groupBy(*group, "tied").agg(F.count_if(F.col("_at") <= F.col("_worst")).alias("depth"))


def tied_with(rows: DataFrame, group: list[str], column: str, sem: str, run_id: str, one: int) -> DataFrame:
    """Rows of the same group that can't be told from a given row; of several rows with its id in a group, the one with the least value."""
    given = rows.where(F.col(run_id) == one).groupBy(*group).agg(F.min(F.struct(F.col(column).alias("v"), F.col(sem).alias("s"))).alias("_g")).select(*group, F.col("_g.v").alias("_v"), F.col("_g.s").alias("_s"))
    return rows.where(F.col(run_id) != one).join(given, group).where(indistinguishable(column, sem, "_v", "_s", zero_sem_is_null=True)).drop("_v", "_s")


def frontier2(rows: DataFrame, group: list[str], x: str, y: str, better: tuple[str, str] = ("min", "min")) -> DataFrame:
    """Rows that no row of the group dominates in two objectives; equal rows stay. The best y at each x, then a running minimum over ranges of x: no pairs,
    and a large group is not in one task."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": signed(x, better[0]), "_y": signed(y, better[1])})
    least = rows.groupBy(*group, "_x").agg(F.min("_y").alias("_least"))
    best = running(least, "_x", {"_least": "_best"}, F.min, group=group).where(F.col("_best").isNull() | (F.col("_least") < F.col("_best"))).select(*group, "_x", F.col("_least").alias("_y"))
    return same(rows, best, [*group, "_x", "_y"], "left_semi").drop("_x", "_y")


#: Comparisons that are made at once, of all points of two sets; larger sets are divided.
AT_ONCE = 1 << 12


def beaten(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each point of b, whether a point of a is smaller or equal in every column. One column is a minimum, two are a sorted sweep; with more, both sets are divided at the
    median of the first column: within the halves all columns count, and from the lower half of a to the upper one of b the first doesn't any more."""
    out = np.zeros(len(b), bool)
    if not len(a) or not len(b):
        return out
    if a.shape[1] == 1:
        return a.min() <= b[:, 0]
    if a.shape[1] == 2:
        order = np.lexsort((a[:, 1], a[:, 0]))
        least = np.minimum.accumulate(a[order, 1])
        before = np.searchsorted(a[order, 0], b[:, 0], "right")
        some = before > 0
        out[some] = least[before[some] - 1] <= b[some, 1]
        return out
    if len(a) * len(b) <= AT_ONCE:
        return (a[None] <= b[:, None]).all(2).any(1)
    both = np.concatenate((a[:, 0], b[:, 0]))
    middle, top = np.partition(both, len(both) // 2)[len(both) // 2], both.max()
    if middle == top:
        below = both[both < top]
        if not len(below):
            return beaten(a[:, 1:], b[:, 1:])
        middle = below.max()
    low_a, low_b = a[:, 0] <= middle, b[:, 0] <= middle
    out[low_b] = beaten(a[low_a], b[low_b])
    high = np.flatnonzero(~low_b)
    high = high[~beaten(a[low_a][:, 1:], b[high][:, 1:])]
    out[~low_b] = True
    out[high] = beaten(a[~low_a], b[high])
    return out


def skyline(points: np.ndarray) -> np.ndarray:
    """The points that no other dominates (all smaller or equal, one smaller), distinct and in order. In lexicographic order a point comes after those that dominate it: the
    frontier of the first half stays, that of the second half less what the first one beats in the other columns."""

    def front(part: np.ndarray) -> np.ndarray:
        if len(part) <= 64:
            return part[(part[None] <= part[:, None]).all(2).sum(1) == 1]  # itself
        one, two = front(part[: len(part) // 2]), front(part[len(part) // 2 :])
        return np.concatenate((one, two[~beaten(one[:, 1:], two[:, 1:])]))

    points = np.unique(points, axis=0)
    return points[:1] if points.shape[1] == 1 else front(points)


#: Points of a group that one task may hold; bits of each objective in the order by which a larger frontier is cut.
FIT, BITS = 500_000, 10


def corners(points: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """For each piece of a group, the least and largest value of each objective."""
    return points.groupBy(*group, "_piece").agg(*(F.min(c).alias(f"_lo{c}") for c in cols), *(F.max(c).alias(f"_hi{c}") for c in cols))


def z_order(points: DataFrame, cols: list[str]) -> Column:
    """The bits of all objectives, scaled to their extents, one from each in turn: what is near in this order is near in every objective."""
    ends = points.agg(*(f(c).alias(f"{n}{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max)))).first()
    bits = min(BITS, 62 // len(cols))
    out = F.lit(0).cast("long")
    for k, c in enumerate(cols):
        span = (ends[f"hi{c}"] - ends[f"lo{c}"]) or 1.0
        cell = F.least(F.lit((1 << bits) - 1), F.floor((F.col(c) - ends[f"lo{c}"]) / span * (1 << bits))).cast("long")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1)), b * len(cols) + k))
    return out


def survivors(points: DataFrame, group: list[str], cols: list[str], pieces: int, kinds: str) -> DataFrame:
    """The points of (group, cols) that no other dominates, of frontiers too large for one task. They are cut into ranges of the Z-order; a piece must meet another one only if the
    lower corner of that is below the upper corner of this, and such pairs of pieces are compared in a task each."""
    z = points.withColumn("_z", z_order(points, cols))
    cut = kept(z.repartitionByRange(pieces, *group, "_z").withColumn("_piece", F.spark_partition_id()).drop("_z"), "pieces")
    box = kept(corners(cut, group, cols), "corners")  # a row for each piece of a group
    other = box.select(*group, F.col("_piece").alias("_by"), *(F.col(f"_lo{c}").alias(f"_other{c}") for c in cols))
    may = reduce(Column.__and__, (F.col(f"_other{c}") <= F.col(f"_hi{c}") for c in cols))
    pairs = kept(same(box, other, group).where(may).select(*group, "_piece", "_by") if group else box.join(other, may).select("_piece", "_by"), "pairs")
    meets = pairs.groupBy(*group, "_piece").agg(F.count("*").alias("_n"))

    def outlived(own: pd.DataFrame, rivals: pd.DataFrame) -> pd.DataFrame:
        x, y = own[cols].to_numpy(float), skyline(rivals[cols].to_numpy(float))
        equal = pd.MultiIndex.from_frame(own[cols]).isin(pd.MultiIndex.from_arrays(y.T)) if len(y) else np.zeros(len(x), bool)
        return own[equal | ~beaten(y, x)][[*group, *cols, "_n"]]

    a = same(cut, same(pairs, meets, [*group, "_piece"]), [*group, "_piece"])
    b = same(cut.withColumnRenamed("_piece", "_by"), pairs, [*group, "_by"])
    key = [*group, "_piece", "_by"]
    b = b.select(*(F.col(c).alias(c) for c in [*key, *cols]))  # new columns, since both sides come from one table
    left = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(outlived, f"{kinds}, _n long")
    return left.groupBy(*group, *cols).agg(F.count("*").alias("_left"), F.first("_n").alias("_n")).where("_left = _n").drop("_left", "_n")


def frontier(rows: DataFrame, objectives: dict[str, str], group: list[str] | None = None, mask: Column | None = None, fan_in: int = 8, fit: int = FIT) -> DataFrame:
    """Rows of each group that no row of it dominates in the objectives (column -> min or max); equal rows stay, and rows with a null or NaN objective, or
    outside the mask, are no candidates. Frontiers of partitions are found in tasks and merged, `fan_in` at a time, in rounds; each round is written. Where
    the merged frontiers of a group would pass `fit` points, they are cut into pieces in Z-order, and pieces meet where their corners allow a point of one to
    dominate a point of the other."""
    if not objectives:
        return rows.limit(0)
    group, cols = group or [], [f"_{i}" for i in range(len(objectives))]
    rows = rows.where(mask) if mask is not None else rows
    for k in objectives:
        rows = rows.where(F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")))
    rows = rows.withColumns({f"_{i}": signed(k, b).cast("double") + F.lit(0.0) for i, (k, b) in enumerate(objectives.items())})
    kinds = ", ".join([*(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group), *(f"{c} double" for c in cols)])

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(skyline(pdf[cols].to_numpy(float)), columns=cols)
        for at, g in enumerate(group):
            found.insert(at, g, pd.Series([pdf[g].iloc[0]] * len(found), dtype=pdf[g].dtype))
        return found

    def local(batches):
        held, count, limit = [], 0, 100_000
        for pdf in batches:
            held.append(pdf)
            count += len(pdf)
            if count > limit:
                held = [pd.concat(map(of_group, split(held)))]
                count = len(held[0])
                limit = max(100_000, 2 * count)
        if held:
            yield from map(of_group, split(held))

    def split(held):
        whole = pd.concat(held)
        return [g for _, g in whole.groupby(group, dropna=False, sort=False)] if group else [whole]

    pieces = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    points = kept(rows.select(*group, *cols).mapInPandas(local, kinds), "frontier")
    while pieces > 1:
        most = points.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if most > fit:
            total = points.count()
            points = survivors(points.distinct(), group, cols, max(pieces, -(-2 * total // fit)), kinds)
            break
        pieces = -(-pieces // fan_in)
        near = points.withColumn("_piece", F.pmod(F.xxhash64(*cols), F.lit(pieces)).cast("int"))
        points = kept(near.groupBy(*group, "_piece").applyInPandas(of_group, kinds), "frontier")
    return same(rows, points.select(*group, *cols), [*group, *cols], "left_semi").drop(*cols)


def frontier_of_finite(rows: DataFrame, measures: dict[str, str | None], group: list[str] | None = None) -> DataFrame:
    """The frontier over the measures that have a better side, of rows in which every measure is finite; none if no measure has a better side."""
    ok = lambda k: F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")) & (F.abs(F.col(k).cast("double")) != float("inf"))
    for k in measures:
        rows = rows.where(ok(k))
    return frontier(rows, {k: b for k, b in measures.items() if b}, group)


def frontier_path(front: DataFrame, group: list[str], x: str, y: str, run_id: str, better: str = "min") -> DataFrame:
    """The last step of the frontier along x: differences of its last two points."""
    w = W.partitionBy(*group).orderBy(signed(x, better), run_id)
    step = front.withColumns({"dx": F.col(x) - F.lag(x).over(w), "dy": F.col(y) - F.lag(y).over(w), "back": F.row_number().over(W.partitionBy(*group).orderBy(signed(x, better).desc(), F.desc(run_id)))})
    return step.where("back = 1 and dx is not null").select(*group, "dx", "dy")
