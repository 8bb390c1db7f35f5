"""Values bound once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated, and planned, once: a body that names its
    argument many times would otherwise hold that many copies of it, and nested ones
    a number that grows exponentially."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
