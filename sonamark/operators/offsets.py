"""Running sums and minima, and ranks, over a global order, or that of a large group, without one task for all its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import kept


def same(left: DataFrame, right: DataFrame, keys: list[str], join: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys go."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if not keys:
        return left.join(F.broadcast(named), F.lit(True), join)  # one row
    out = left.join(named, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)), join)
    return out.drop(*(f"_r_{k}" for k in keys)) if join not in ("left_semi", "left_anti") else out


def ranges_of(rows: DataFrame, order: list[str], pieces: int | None = None, group: list[str] | None = None) -> DataFrame:
    """rows with _piece, the number of the range of (group, order) that each is in, and _at, a number that rises with the order within the range; nulls come first. The
    order is of any number of columns that can be compared, cut by Spark's sample of it; only rows that agree in all of them can't be parted. Written, since
    a range must have the same rows in every use."""
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(group or []), *order]
    cut = rows.repartitionByRange(pieces, *by).sortWithinPartitions(*by)
    return kept(cut.withColumns({"_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")


def listed(order: str | list[str], tie: str | None) -> list[str]:
    return [*([order] if isinstance(order, str) else order), *([tie] if tie else [])]


def running(rows: DataFrame, order: str | list[str], values: dict[str, str], how=F.sum, pieces: int | None = None, tie: str | None = None, group: list[str] | None = None) -> DataFrame:
    """rows with how (sum or min) of each value (column -> name of the result) over the rows before them, in their group, in the order given (and tie, its last column); null
    before the first. Rows that agree in all of these are in an arbitrary order. Windows run within ranges, and each range starts from what those before
    it in the group come to: a row for each range that a group lies in."""
    group, rows = group or [], ranges_of(rows, listed(order, tie), pieces, group)
    totals = rows.groupBy(*group, "_piece").agg(*(how(v).alias(f"_t_{o}") for v, o in values.items()))
    earlier = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*group, "_piece", *(how(f"_t_{o}").over(earlier).alias(f"_b_{o}") for o in values.values()))
    inside = W.partitionBy(*group, "_piece").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    out = same(rows.withColumns({f"_i_{o}": how(v).over(inside) for v, o in values.items()}), before, [*group, "_piece"])

    def both(value: str, name: str) -> Column:
        a, b = F.col(f"_b_{name}"), F.col(f"_i_{name}")
        return F.least(a, b) if how is F.min else F.coalesce(a + b, a, b)

    return out.withColumns({o: both(v, o) for v, o in values.items()}).drop("_piece", "_at", *(f"_{k}_{o}" for k in "bi" for o in values.values()))


def prefix_sums(rows: DataFrame, order: str | list[str], values: dict[str, str], pieces: int | None = None, tie: str | None = None, group: list[str] | None = None) -> DataFrame:
    """running() with sums, 0 before the first row."""
    return running(rows, order, values, F.sum, pieces, tie, group).withColumns({o: F.coalesce(o, F.lit(0)) for o in values.values()})


def numbered(rows: DataFrame, order: str | list[str], out: str, pieces: int | None = None, tie: str | None = None, group: list[str] | None = None) -> DataFrame:
    """rows with their number in their group, from 1. Numbers within a range come with the sort, so there is no window over rows."""
    group, rows = group or [], ranges_of(rows, listed(order, tie), pieces, group)
    counts = rows.groupBy(*group, "_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*group, "_piece", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    return same(rows, before, [*group, "_piece"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_piece", "_at", "_shift")


def stride_offsets(rows: DataFrame, order: str | list[str], stride: int, out: str, tie: str | None = None) -> DataFrame:
    """Offsets of records of one size: stride times the number of records before."""
    return numbered(rows, order, out, tie=tie).withColumn(out, (F.col(out) - 1) * stride)
