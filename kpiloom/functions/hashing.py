"""Deterministic, stateless bucketing of ids (A/B assignment, seeded splits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fingerprint import farm_fingerprint


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_prefix_int(text: Column, hex_digits: int = 8) -> Column:
    """First ``hex_digits`` hex digits of ``md5(text)`` as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("bigint")


def bucket(id_col, n: int = 100, method: str = "md5", salt: str | Column | None = None) -> Column:
    """Bucket in ``[0, n)`` from the id's text form; null id -> null bucket.  ``salt``
    (a text, or a column of texts) makes another, independent assignment.

    ``md5``: first 8 hex digits of md5 (reproducible in any SQL engine);
    ``xxhash64``: the fast built-in hash; ``farm``: the published 64-bit fingerprint
    that warehouses offer, taken as ``abs(hash) mod n`` (the one hash whose absolute
    value is out of range, -2^63, raises under ANSI, as it does there).
    """
    text = _c(id_col).cast("string")
    if salt is not None:
        text = F.concat(F.lit(salt), F.lit(":"), text)
    if method == "md5":
        h = md5_prefix_int(text, 8)
    elif method == "xxhash64":
        h = F.xxhash64(text)
    elif method == "farm":
        h = F.abs(farm_fingerprint(text))
    else:
        raise ValueError(f"unknown hash method {method!r}")
    return F.pmod(h, F.lit(n))
