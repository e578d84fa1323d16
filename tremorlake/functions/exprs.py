"""Small column expressions shared across operators (all JVM side)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
WATER_RHO = 1000.0
GRAVITY = 9.81


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int) -> Column:
    """Rounded double without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), 2
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def eps_to_dvv(eps: Column | str) -> Column:
    """Exact map from stretch factor to dv/v; NULL for an unphysical stretch."""
    e = col(eps)
    return F.when(e > -1.0, -e / (1.0 + e))


def weaver_error(cc: Column, freq_hz: Column, t1: Column, t2: Column) -> Column:
    """Stretching standard error from coherence; NULL outside 0 < cc <= 1."""
    omega = 2 * math.pi * freq_hz
    lapse = F.pow(omega, 2) * (F.pow(t2, 3) - F.pow(t1, 3))
    shape = (1 - cc * cc) / (2 * cc * cc)
    value = F.sqrt(shape * 6.0 * math.sqrt(math.pi / 2.0) / lapse)
    return F.when((cc > 0) & (cc <= 1) & (t2 > t1), value)


def normal_key(c: Column | str) -> Column:
    """lower, trim, dashes and blanks to underscores."""
    return F.regexp_replace(F.lower(F.trim(col(c))), "[- ]", "_")


def day(ts: str = "ts", name: str = "day") -> Column:
    return F.to_date(ts).alias(name)
