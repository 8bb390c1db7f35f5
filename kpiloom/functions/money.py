"""Exact money sums.

Prices are summed as whole units of 1e-4 in ``bigint``: exact, independent of
partitioning and summation order (a double sum is neither), on the long fast
path (a ``decimal(18,4)`` sum widens to ``decimal(28,4)``, which Spark keeps as
BigInteger bytes and reallocates per row), and an overflow raises under ANSI
instead of wrapping.  The result is returned as ``units / 10000`` in double,
the correctly rounded value of the exact sum below 2^53 units (9e11 in money).

What whole units cannot hold - digits below 1e-4, prices beyond 9e14, NaN and the
infinities - is summed beside them in double.  That rest is exactly 0.0 for every
price of up to four decimals below 9e11, so it changes no such sum, and it keeps
every other sum what a plain double sum gives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: money is exact to four decimal places.
MONEY_SCALE = 10_000


# Prices at or beyond this (and NaN, which sorts above all) go to the rest whole.
LARGEST_IN_UNITS = 9e14


def as_units(c) -> Column:
    """A price as whole 1e-4 units (rounded to four decimals), ``bigint``; 0 when
    units cannot hold it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < LARGEST_IN_UNITS, F.round(c * F.lit(MONEY_SCALE)).cast("bigint")) \
        .when(c.isNotNull(), zero_units())


def as_rest(c) -> Column:
    """What :func:`as_units` leaves of a price, in double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < LARGEST_IN_UNITS, c - as_units(c) / F.lit(float(MONEY_SCALE))).otherwise(c)


def money_sum(c) -> Column:
    """Exact sum in 1e-4 units (null-ignoring, null on no input)."""
    return F.sum(as_units(c))


def rest_sum(c) -> Column:
    """The double sum of what the units do not hold (0.0 for ordinary prices)."""
    return F.sum(as_rest(c))


def zero_units() -> Column:
    return F.lit(0).cast("bigint")


def units_to_double(c, rest=None) -> Column:
    """The amount of ``c`` units and, if given, the rest beside them."""
    c = F.col(c) if isinstance(c, str) else c
    amount = c / F.lit(float(MONEY_SCALE))
    return amount if rest is None else amount + F.coalesce(F.col(rest) if isinstance(rest, str) else rest,
                                                           F.lit(0.0))
