"""Calendar cycles as sine and cosine, and time lags."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
#: Seconds of each unit.
SECONDS = {"minute": 60.0, "hour": 3600.0, "day": 86400.0, "week": 604800.0, "month": 2629756.8, "year": 31557600.0}


def _days_in_month(ts: Column) -> Column:
    return F.day(F.last_day(ts))


#: (part, whole) -> share of the whole that has passed
RATIOS = {
    ("minute", "hour"): lambda t: F.minute(t) / F.lit(60.0),
    ("hour", "day"): lambda t: (F.hour(t) + F.when(F.minute(t) >= 30, 1).otherwise(0)) / F.lit(24.0),
    ("day", "week"): lambda t: (F.weekday(t) + 1) / F.lit(7.0),
    ("day", "month"): lambda t: F.day(t) / _days_in_month(t).cast("double"),
    ("day", "year"): lambda t: F.dayofyear(t) / F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))).cast("double"),
    ("week", "month"): lambda t: F.round(F.day(t) / F.lit(7.0), 1) / F.floor(_days_in_month(t) / 7).cast("double"),
    ("week", "year"): lambda t: F.rint(F.dayofyear(t) / F.lit(7.0)) / F.lit(52.1775),
    ("month", "year"): lambda t: F.month(t) / F.lit(12.0),
}


def cycle(ts: Column, part: str, whole: str) -> tuple[Column, Column]:
    """Sine and cosine of the place in the cycle."""
    angle = RATIOS[part, whole](ts) * TAU
    return F.sin(angle), F.cos(angle)


def cycle_angle(sine: Column, cosine: Column) -> Column:
    """The share of the cycle again, from 0 to 1."""
    share = F.atan2(sine, cosine) / TAU
    return F.when(share < 0, share + 1).otherwise(share)


def lag(target: Column, anchor: Column, unit: str = "hour", zone_target: Column | int = 0, zone_anchor: Column | int = 0, total: bool = False) -> Column:
    """Distance of two local times in units; whole days don't count unless total is set. Zones are hours, without daylight saving."""
    zones = [z if isinstance(z, Column) else F.lit(z) for z in (zone_target, zone_anchor)]
    local = [F.unix_timestamp(t.cast("timestamp")) + z * 3600 for t, z in zip((target, anchor), zones, strict=True)]
    seconds = F.abs(local[0] - local[1])
    return (seconds if total else F.pmod(seconds, F.lit(86400))) / F.lit(SECONDS[unit])


def lag_encode(value: Column, low: float, high: float) -> Column:
    """Clipped to three quarters of the fitted minimum and five quarters of the maximum, then scaled so that the maximum is 0."""
    return (F.least(F.greatest(value, F.lit(0.75 * low)), F.lit(1.25 * high)) - F.lit(high)) / F.lit(high - low)


def lag_decode(value: Column, low: float, high: float) -> Column:
    return value * F.lit(high - low) + F.lit(high)


def localise(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours)


def to_timestamp(text: Column) -> Column:
    """The first of the usual formats that fits, else null."""
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyy/MM/dd"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


#: How many parts a whole has, to turn a share of a cycle into its unit again.
PARTS = {("minute", "hour"): 60.0, ("hour", "day"): 24.0, ("day", "week"): 7.0, ("day", "month"): 30.437, ("day", "year"): 365.25, ("week", "month"): 4.345, ("week", "year"): 52.1775, ("month", "year"): 12.0}


def cycle_value(share: Column, part: str, whole: str) -> Column:
    return share * F.lit(PARTS[part, whole])
