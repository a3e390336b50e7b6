"""Matching measured runs to published rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import col
from ..sources.store import kept


def close(a, b, tolerance: float = 1e-9):
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def cells(x, width: float = 1e-6, reach: float = 2e-9):
    """(the cell of a number, the one or two cells that numbers close to it are in): on a scale on which a relative distance from 1 up, and an
    absolute one below, has about the same length everywhere. Close numbers are within reach of one another on it."""
    at = F.signum(col(x)) * F.ln(1 + F.abs(col(x)))
    return F.floor(at / width), F.array_distinct(F.array(F.floor((at - reach) / width), F.floor((at + reach) / width)))


def match_runs(runs: DataFrame, rows: DataFrame, run_id: str, row_id: str, key: list[str], loose: list[str], dims: list[str]) -> DataFrame:
    """(run_id, row_id, how): by the whole key first; then by a loose key and close dimensions (null matches nothing), one run after the other in the order of run_id: a run
    with just one candidate that no run before it took, takes that one."""
    r, p = runs.select(run_id, *{*key, *loose, *dims}), rows.select(row_id, *{*key, *loose, *dims})
    by_name = kept(r.join(p.select(row_id, *key), key).groupBy(run_id).agg(F.min(row_id).alias(row_id)).withColumn("how", F.lit("name")), "by_name")
    free = p.join(by_name.select(row_id), row_id, "left_anti")
    left = r.join(by_name.select(run_id), run_id, "left_anti")
    by_specs = match_in_turn(left, free, run_id, row_id, loose, dims)
    return by_name.select(run_id, row_id, "how").unionByName(by_specs.withColumn("how", F.lit("specs")))


def match_in_turn(runs: DataFrame, rows: DataFrame, run_id: str, row_id: str, loose: list[str], dims: list[str], most_rounds: int = 1000) -> DataFrame:
    """(run_id, row_id) that runs take in turn, each the one candidate of its loose key and close dimensions that is still there, if it is just one.

    Runs of equal specs have the same candidates, so they are one class, and rows of equal specs count as one. A take needs a count of one in all, so rows that come twice
    are never taken, and a class that has such rows takes nothing; other classes take once at most, since nothing is left for the rest. Classes that share
    candidates are connected. In each round the first run, in each set of connected classes, whose class has one candidate left takes it; classes that
    lose a candidate by it go on with the runs after that. Sets of more than one class need dimensions that are close and not equal."""
    spec = [*loose, *dims]
    some = lambda df: df.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in spec)))
    classes = kept(some(runs).select(*spec).distinct().withColumn("c", F.monotonically_increasing_id()), "classes")
    stock = kept(some(rows).groupBy(*(F.col(k) for k in loose), *(F.col(d).alias(f"_{d}") for d in dims)).agg(F.min(row_id).alias(row_id), F.count("*").alias("n")), "stock")
    near = reduce(Column.__and__, (close(d, f"_{d}") for d in dims))
    at = [f"_cell{i}" for i in range(len(dims))]
    a, b = classes, stock
    for cell, d in zip(at, dims):  # close values are in the same cells, so the loose key alone makes no candidates
        a, b = a.withColumn(cell, F.explode(cells(d)[1])), b.withColumn(cell, cells(f"_{d}")[0])
    links = kept(a.join(b, [*loose, *at]).where(near).select("c", row_id, "n"), "links")
    blocked = links.where("n > 1").select("c").distinct()
    links = kept(links.join(blocked, "c", "left_anti").select("c", row_id).withColumn("since", F.lit(None).cast(runs.schema[run_id].dataType)), "links")
    members = kept(some(runs).select(run_id, *spec).join(classes.select("c", *spec), spec).select("c", run_id), "members")
    sets = connected(links, "c", row_id, most_rounds)
    taken = []
    for _ in range(most_rounds):
        # A class may take from the run after the one that made its candidate the only one; null: from its first.
        single = links.groupBy("c").agg(F.count("*").alias("k"), F.min(row_id).alias(row_id), F.max("since").alias("since")).where("k = 1")
        turn = single.join(members, "c").where(F.col("since").isNull() | (F.col(run_id) > F.col("since"))).groupBy("c", row_id).agg(F.min(run_id).alias(run_id))
        first = turn.join(sets, "c").groupBy("s").agg(F.min(F.struct(run_id, row_id, "c")).alias("t"))
        now = kept(first.select(F.col(f"t.{run_id}").alias(run_id), F.col(f"t.{row_id}").alias(row_id), F.col("t.c").alias("c")), "taken")
        if now.isEmpty():
            break
        taken.append(now.select(run_id, row_id))
        gone = now.select(F.col("c").alias("_by"), row_id, F.col(run_id).alias("_when"))
        lost = links.join(gone, row_id).select("c", "_when")
        rest = links.join(now.select("c"), "c", "left_anti").join(gone.select(row_id), row_id, "left_anti")
        links = kept(rest.join(lost.groupBy("c").agg(F.max("_when").alias("_when")), "c", "left").select("c", row_id, F.greatest("since", "_when").alias("since")), "links")
    else:
        raise RuntimeError("matching did not settle")
    return reduce(DataFrame.union, taken) if taken else runs.join(rows.select(row_id), F.lit(False)).select(run_id, row_id)


def connected(links: DataFrame, node: str, through: str, most_rounds: int) -> DataFrame:
    """(node, s): the least node that is reached from each over shared values of `through`."""
    labels = links.select(node, F.col(node).alias("s")).distinct()
    for _ in range(most_rounds):
        least = links.join(labels, node).groupBy(through).agg(F.min("s").alias("m"), F.max("s").alias("w"))
        if (least := kept(least, "labels")).where("m < w").isEmpty():
            return labels
        labels = kept(links.join(least, through).groupBy(node).agg(F.min("m").alias("s")), "labels")
    raise RuntimeError("sets did not settle")
