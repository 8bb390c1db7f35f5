"""Calendar functions on ``timestamp_ntz`` / ``date`` columns.

All of them are zone-free: they never pass through a session-zone TIMESTAMP, so
results do not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_of(ts) -> Column:
    """Calendar day of a timestamp (``date(ts)``)."""
    return _c(ts).cast("date")


def day_start(ts) -> Column:
    """Midnight of the day, still a ``timestamp_ntz`` (``date_trunc(ts, day)``)."""
    return _c(ts).cast("date").cast("timestamp_ntz")


def week_start(d, start: str = "monday") -> Column:
    """First day of the week containing ``d`` (a date or timestamp).

    ``monday`` = ISO weeks; ``sunday`` = weeks starting on Sunday.
    """
    d = _c(d).cast("date")
    if start == "monday":
        return F.trunc(d, "week")
    if start == "sunday":
        # dayofweek: 1 = Sunday ... 7 = Saturday
        return F.date_sub(d, F.dayofweek(d) - 1)
    raise ValueError(f"unknown week start {start!r}")


def weeks_between(later, earlier) -> Column:
    """Whole weeks between two week starts (both must be week starts)."""
    return F.floor(F.datediff(_c(later), _c(earlier)) / F.lit(7)).cast("bigint")


def full_days_between(later, earlier) -> Column:
    """Whole 24-hour periods from ``earlier`` to ``later``, truncated toward zero.

    23:00 -> 01:00 next day is 0 days (``datediff`` would say 1).
    """
    return F.extract(F.lit("DAY"), _c(later) - _c(earlier)).cast("bigint")


def add_days(ts, n: int) -> Column:
    """``ts + INTERVAL n DAY``; keeps ``timestamp_ntz``."""
    return _c(ts) + F.make_dt_interval(F.lit(n))
