"""Date and duration expressions with pandas-compatible semantics."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_US_PER_DAY = 86_400_000_000
_US_PER_HOUR = 3_600_000_000


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def floor_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, floored (−10 h → −1), like
    ``Timedelta.days``.  ``datediff`` would truncate calendar days instead."""
    return F.floor(micros_between(start, end) / F.lit(_US_PER_DAY)).cast("int")


def fractional_hours(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(_US_PER_HOUR)


def add_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, ts)


def weekday_mon0(ts: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(ts)


def lenient_timestamp(c: Column) -> Column:
    """Unparseable strings become null instead of failing (ANSI mode)."""
    return c.try_cast("timestamp_ntz")
