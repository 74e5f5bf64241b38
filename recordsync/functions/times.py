"""Times as column expressions; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"day": 86_400, "hour": 3_600}


def date_text(ts: Column) -> Column:
    """``YYYY-MM-DD``."""
    return F.date_format(ts, "yyyy-MM-dd")


def hour_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH``."""
    return F.date_format(ts, "yyyy-MM-dd HH")


def second_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def next_boundary(ts: Column, unit: str) -> Column:
    """The next midnight or full hour; a time just on one moves by a whole unit."""
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / (UNITS[unit] * 1_000_000)) + 1).cast("long") * (UNITS[unit] * 1_000_000))


def expiry(created: Column, seconds: Column) -> Column:
    """Creation plus a validity period; null if either is, or the period is 0 (never)."""
    return F.timestamp_micros(F.unix_micros(created) + F.nullif(seconds.cast("long"), F.lit(0)) * 1_000_000)


def is_expired(created: Column, seconds: Column, now: Column) -> Column:
    """Whether the expiry lies before ``now``; false without one."""
    return F.coalesce(expiry(created, seconds) < now, F.lit(False))
