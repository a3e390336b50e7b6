"""Statistics of repeated shots, baselines and verification. Three averages that must not be mixed: of levels, of linear values, of power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level
from .offsets import prefix_sums, same


def run_statistics(shots: DataFrame, keys: list[str], value: str = "value", shot: str = "shot", excluded: str | None = "excluded") -> DataFrame:
    """n, mean, sd, sem of the levels of each key, and the first-round effect: shot 1 less the mean of the others, where the first
    shot with a value is number 1 and is not alone."""
    rows = shots.where(F.col(value).isNotNull() & (~F.col(excluded) if excluded else F.lit(True)))
    agg = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(shot).alias("_first"), F.min_by(value, shot).alias("_v1"), F.sum(value).alias("_sum"))
    pop = F.when((F.col("_first") == 1) & (F.col("n") >= 2), F.col("_v1") - (F.col("_sum") - F.col("_v1")) / (F.col("n") - 1))
    return agg.select(*keys, "n", "mean", "sd", (F.col("sd") / F.sqrt("n")).alias("sem"), pop.alias("pop"))


def linear_levels(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Levels of the means of linear values."""
    return rows.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values)).select(*keys, *(level(v).alias(f"{v}_db") for v in values))


def band_statistics(rows: DataFrame, keys: list[str], levels: str, centres: Column, low_hz: float = 250.0) -> DataFrame:
    """(keys, band, centre, level) energy means, then low-frequency level and centroid: returns keys, low_db, centroid_hz, spectrum."""
    long = rows.select(*keys, F.posexplode(F.arrays_zip(F.col(levels).alias("l"), centres.alias("c"))).alias("band", "x")).select(*keys, "band", F.col("x.l").alias("l"), F.col("x.c").alias("c"))
    power = long.groupBy(*keys, "band", "c").agg(F.avg(F.when(F.isnan("l") | F.col("l").isNull(), 0.0).otherwise(F.pow(F.lit(10.0), F.col("l") / 10))).alias("p"))
    spectrum = F.transform(F.array_sort(F.collect_list(F.struct("band", F.when(F.col("p") > 0, 10 * F.log10("p")).alias("v")))), lambda s: s.v)
    out = power.groupBy(*keys).agg(F.sum(F.when(F.col("c") <= low_hz, F.col("p")).otherwise(0.0)).alias("low"), F.try_divide(F.sum(F.col("c") * F.col("p")), F.sum("p")).alias("centroid_hz"), spectrum.alias("spectrum"))
    return out.select(*keys, F.when(F.col("low") > 0, 10 * F.log10("low")).alias("low_db"), "centroid_hz", "spectrum")


def net_reduction(runs: DataFrame, keys: list[str], value: str, is_baseline: str, run_id: str) -> DataFrame:
    """Baseline's value less the run's, where a baseline has the same keys; of several baselines that with the largest id."""
    base = runs.where(F.col(is_baseline) & F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, run_id).alias("_ref"))
    return runs.where(~F.col(is_baseline) & F.col(value).isNotNull()).join(base, keys).select(run_id, *keys, (F.col("_ref") - F.col(value)).alias("reduction"))


def verify(found: DataFrame, published: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.01) -> DataFrame:
    """For each column: cells on both sides, those of missing values too, cells over the tolerance, worst difference."""
    both = found.join(published.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns)), keys)
    cells = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.abs(F.col(c) - F.col(f"_{c}")).alias("delta")) for c in columns))).alias("x")).select("x.*")
    return cells.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("delta") > tolerance).alias("over"), F.max("delta").alias("worst"))


def extent(rows: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    ok = F.when(~F.isnan(column) & (F.abs(F.col(column)) != float("inf")), F.col(column))
    return rows.groupBy(*keys).agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"))


def availability(rows: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, n): values that aren't null, for all measures in one pass."""
    counts = rows.agg(*(F.count(m).alias(m) for m in measures))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in measures))).alias("x")).select("x.*")


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    out = rows.groupBy(row).pivot(column, values).count().na.fill(0)
    return out.withColumn("total", sum((F.col(str(v)) for v in values[1:]), F.col(str(values[0]))))


def median(rows: DataFrame, column: str) -> DataFrame:
    """One row: the exact median of the values that aren't null, by their ranks. Equal values are one row of counts, and no task holds all values. Null if there are none."""
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    x = prefix_sums(values, "v", {"n": "at"})
    half = F.col("all") / 2
    inside = lambda k: (F.col("at") <= k) & (k < F.col("at") + F.col("n"))
    middle = same(x, x.agg(F.sum("n").alias("all")), []).select("v", inside(F.floor((F.col("all") - 1) / 2)).alias("lower"), inside(F.floor(half)).alias("upper"))
    return middle.agg(((F.max(F.when(F.col("lower"), F.col("v"))) + F.max(F.when(F.col("upper"), F.col("v")))) / 2).alias("median"))
