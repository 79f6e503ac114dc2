"""Column-level feature functions (all JVM-side expressions, codegen friendly)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.schemas import TYPE_CODES, TYPE_UNKNOWN_BATCH, TYPE_UNKNOWN_ONLINE

EARTH_RADIUS_KM = 6371.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    c = _c(c)
    if hi is not None:
        c = F.least(c, F.lit(hi))
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    return c


def log_amount(amount) -> Column:
    return F.log1p(_c(amount))


def large_flag(amount, at: float = 50000) -> Column:
    return (_c(amount) > at).cast("int")


def balance_change(old, new) -> Column:
    return _c(old) - _c(new)


def balance_ratio(amount, old, profile: str = "batch") -> Column:
    """``batch``: old>0 ? amount/old : 0, clipped to [0, 100].
    ``online``: min(amount / max(old, 1), 100), no lower clip."""
    amount, old = _c(amount), _c(old)
    if profile == "batch":
        raw = F.when(old > 0, amount / old).otherwise(F.lit(0.0))
        return clip(raw, 0.0, 100.0)
    if profile == "online":
        return F.least(amount / F.greatest(old, F.lit(1.0)), F.lit(100.0))
    raise ValueError(f"unknown profile {profile!r}")


def type_code(t, profile: str = "batch") -> Column:
    unknown = TYPE_UNKNOWN_BATCH if profile == "batch" else TYPE_UNKNOWN_ONLINE
    mapping = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TYPE_CODES.items()))
    return F.coalesce(F.try_element_at(mapping, _c(t)), F.lit(unknown)).cast("int")


def haversine_km(lat, lng, plat, plng) -> Column:
    lat, lng, plat, plng = map(_c, (lat, lng, plat, plng))
    dlat = F.radians(lat - plat)
    dlng = F.radians(lng - plng)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(plat)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def impossible_travel(km, at: float = 500) -> Column:
    return (_c(km) > at).cast("int")


def is_night(hour, start: int = 23, end: int = 5) -> Column:
    h = _c(hour)
    return ((h >= start) | (h <= end)).cast("int")


def deviation(amount, avg) -> Column:
    return F.abs(_c(amount) - _c(avg))


def nonfinite_to_zero(c) -> Column:
    """+-inf -> NaN -> 0 and null -> 0."""
    c = _c(c)
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def bullets(arr) -> Column:
    return F.array_join(F.transform(_c(arr), lambda x: F.concat(F.lit("- "), x)), "\n")


def display_name(c) -> Column:
    return F.regexp_replace(_c(c), "_", " ")
