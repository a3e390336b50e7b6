"""Row selection by a specification, and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selection(rows: DataFrame, spec: dict[str, set | list | tuple]) -> DataFrame:
    """spec: column -> a set of values, or (lo, hi) with None for an open end. Null never passes a range."""
    test = F.lit(True)
    for name, want in spec.items():
        if name not in rows.columns:
            raise ValueError(f"no column {name}")
        numeric = rows.schema[name].dataType.typeName() in {"integer", "long", "float", "double", "short"}
        if isinstance(want, tuple):
            lo, hi = want
            test &= F.col(name).isNotNull()
            test &= F.col(name) >= lo if lo is not None else F.lit(True)
            test &= F.col(name) <= hi if hi is not None else F.lit(True)
        elif numeric:
            raise ValueError(f"{name} is a number: give a range")
        else:
            test &= F.col(name).isin(*want)
    return rows.where(test)


def range_of(a: Column, b: Column, lo: Column, hi: Column, step: Column) -> Column:
    """(from, to) with reversed bounds swapped and a missing one set to the extent; a bound within half a step of the extent is open (null)."""
    ok = lambda x, other: F.when(x.isNull() | F.isnan(x), other).otherwise(x)
    p, q = F.least(ok(a, lo), ok(b, hi)), F.greatest(ok(a, lo), ok(b, hi))
    return F.struct(F.when(p > lo + step / 2, p).alias("from"), F.when(q < hi - step / 2, q).alias("to"))


def years_or_all(asked: DataFrame, present: DataFrame, year: str) -> DataFrame:
    """Asked years that are present; all that are present where none is left."""
    years = present.distinct()  # before the join, so that no row but one a year and task is shuffled
    some = years.join(asked, year, "left_semi")
    rest = years.crossJoin(F.broadcast(some.agg(F.count("*").alias("_n")))).where("_n = 0").drop("_n")
    return some.unionByName(rest)


def known_dimensions(rows: DataFrame, keys: list[str], columns: list[str], defects: DataFrame) -> DataFrame:
    """rows with zero dimensions set to null, and those that a curated list (keys, fields) says are wrong."""
    listed = rows.join(defects.select(*keys, F.col("fields").alias("_bad")), keys, "left")
    bad = lambda c: F.coalesce(F.array_contains("_bad", c), F.lit(False))
    return listed.withColumns({c: F.when(~bad(c) & (F.col(c) != 0), F.col(c)) for c in columns}).drop("_bad")


def pseudo_random(rows: DataFrame, key: str, n: int, factor: int = 7919, modulus: int = 104_729) -> DataFrame:
    """The n rows that come first in the order of key * factor modulo a prime: the same ones each time."""
    return rows.orderBy(F.pmod(F.col(key) * factor, F.lit(modulus)), key).limit(n)


def footnote_years(rows: DataFrame, year: str, where: Column) -> DataFrame:
    """The years that a selection touches."""
    return rows.where(where).select(year).distinct()
