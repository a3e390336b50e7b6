"""Pressure, level and spectrum expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reference pressure in Pa, metrics' published labels, microphone of each channel, and their order.
P0 = 2e-5
METRICS = {"PkPr": "peak_pressure_pa", "dB": "peak_db", "dB(A)": "peak_dba", "Im-Pa": "impulse_pa_ms", "Im-dB": "impulse_db_ms", "Pk Leq": "peak_leq10ms_dba"}
SIGNALS = {"Mil Left": "ML", "Mil Right": "MR", "Right Ear": "SE", "225 Deg ASA": "225"}
MIC_ORDER = ["SE", "ML", "MR", "225"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def level(x: Column | str, ref: float = P0) -> Column:
    """20 log10(x / ref); null where x is zero or less."""
    return F.when(col(x) > 0, 20 * F.log10(col(x) / ref))


def finite(x: Column | str) -> Column:
    """Null for NaN and the infinities."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def volume(diameter: Column | str, length: Column | str) -> Column:
    return 0.785 * col(diameter) * col(diameter) * col(length)


def half_away(x: Column | str) -> Column:
    """Rounded to an integer, halves away from zero."""
    return F.round(col(x)).cast("long")


def to_places(x: Column | str, places: int) -> Column:
    """Rounded to decimal places as SQL does it, in doubles: the product with 10^places, its halves away from zero. F.round rounds the printed decimals
    instead, so it takes 1.005, a double just below that half, up to 1.01. A value whose product is beyond all doubles stays."""
    scaled = col(x) * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**places).otherwise(col(x))


def half_even(x: Column | str) -> Column:
    return F.rint(col(x)).cast("long")


def instantaneous(samples: Column | str, ref: Column | None = None, own: Column | None = None) -> Column:
    """Level of each sample against ref, else the record's own reference, else P0."""
    r = F.coalesce(*(x for x in (ref, own, F.lit(P0)) if x is not None))
    return F.transform(col(samples), lambda p: F.when(p != 0, 20 * F.log10(F.abs(p) / r)))


def centres(lo: int = -16, hi: int = 13) -> Column:
    """Band centres 1000 * 10**(n / 10)."""
    return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda n: 1000 * F.pow(F.lit(10.0), n / 10))


def per_hertz(levels: Column | str, at: Column) -> Column:
    """Level of each band over its width; nulls stay."""
    return F.zip_with(col(levels), at, lambda v, c: v - 10 * F.log10(c * (2 ** (1 / 6) - 2 ** (-1 / 6))))


def indistinguishable(a, sa, b, sb, sigma: float = 2.0, zero_sem_is_null: bool = False) -> Column:
    """abs(a - b) < sigma * hypot(sa, sb); false where an error is missing."""
    sa, sb = col(sa), col(sb)
    if zero_sem_is_null:
        sa, sb = F.nullif(sa, F.lit(0.0)), F.nullif(sb, F.lit(0.0))
    return F.coalesce(F.abs(col(a) - col(b)) < sigma * F.sqrt(sa * sa + sb * sb), F.lit(False))
