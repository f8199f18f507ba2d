"""Epoch-nanosecond dates. Layer tables hold days as BIGINT nanoseconds since 1970-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def day_number(ns: Column | str) -> Column:
    """Days since the epoch, rounding towards the past."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    return F.floor((ns - F.pmod(ns, F.lit(DAY_NS))) / F.lit(DAY_NS)).cast("long")


def as_date(ns: Column | str) -> Column:
    return F.date_from_unix_date(day_number(ns).cast("int"))


def as_ns(day: Column | str) -> Column:
    """Epoch nanoseconds of a DATE."""
    return F.unix_date(day).cast("long") * F.lit(DAY_NS)


def week_start(ns: Column | str) -> Column:
    """Monday of the week in epoch nanoseconds (day 0 of the epoch was a Thursday)."""
    days = day_number(ns)
    return (days - F.pmod(days + F.lit(3), F.lit(7))) * F.lit(DAY_NS)
