"""Deterministic A/B assignment and per-group conversion metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket


def assign(id_col, share_a: int = 50, method: str = "md5", n_buckets: int = 100) -> F.Column:
    """The group of an id: 'A' for buckets below ``share_a``, else 'B' (null id -> 'B')."""
    return F.when(bucket(id_col, n_buckets, method) < share_a, F.lit("A")).otherwise(F.lit("B"))


def ab_group(users: DataFrame, share_a: int = 50, method: str = "md5", n_buckets: int = 100) -> DataFrame:
    """``(user_id, ab_group)``: bucket = hash(id as text) mod 100; buckets below
    ``share_a`` -> 'A', else 'B'.  A null id falls to the ELSE branch -> 'B'.

    Stateless and row-local (no shuffle); stable under any repartitioning.  The
    hash is a parameter: ``md5`` (first 8 hex digits, reproducible in SQL),
    ``xxhash64``, or ``farm`` (the warehouse fingerprint, which reproduces
    assignments made there).
    """
    return users.select(F.col("id").alias("user_id"),
                        assign("id", share_a, method, n_buckets).alias("ab_group"))


def ab_metrics(funnel: DataFrame, groups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Funnel ⋈ assignment on ``user_id``; per group: ``users`` (rows),
    ``converters`` (sum of converted) and ``conversion_rate`` (null when 0 users).

    ``keys`` adds segment columns (taken from the funnel side) to the grouping.
    The grouped aggregate has two groups; partial aggregation makes every map
    task emit at most two rows per segment, so the group size does not matter.
    """
    keys = list(keys or [])
    j = funnel.select("user_id", "converted", *keys).join(groups.select("user_id", "ab_group"), "user_id", "inner")
    conv = F.col("converted").cast("bigint")
    agg = j.groupBy(*keys, "ab_group").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum(conv).alias("converters"),
    )
    return agg.select(
        *keys, "ab_group",
        F.col("users").cast("bigint").alias("users"),
        F.col("converters").cast("bigint").alias("converters"),
        F.try_divide(F.col("converters"), F.col("users")).alias("conversion_rate"),
    )


def ab_metrics_from_users(users: DataFrame, events: DataFrame, orders: DataFrame, share_a: int = 50,
                          method: str = "md5", keys: dict[str, F.Column] | None = None) -> DataFrame:
    """Gold A/B metrics (:func:`ab_metrics` of the funnel joined with the
    assignment of every user row) from one read of ``users``.

    The assignment is a function of the id, so instead of scanning and
    shuffling the users a second time to join it on, each distinct id carries
    its number of user rows ``n`` (the join's multiplicity) and gets its group
    as a column: ``users = sum(n)``, ``converters = sum(n * converted)``.  A
    null id never matches in the join, so it is left out.  ``keys`` are segment
    columns, each a function of the user row, named like ``{name: column}``.
    """
    keys = dict(keys or {})
    from .funnel import funnel_with_rows
    f = funnel_with_rows(users, events, orders, keys=keys).filter(F.col("user_id").isNotNull())
    agg = f.groupBy(*keys, assign("user_id", share_a, method).alias("ab_group")).agg(
        F.sum("n").alias("users"),
        F.sum(F.col("n") * F.col("converted").cast("bigint")).alias("converters"),
    )
    return agg.select(
        *keys, "ab_group",
        F.col("users").cast("bigint").alias("users"),
        F.col("converters").cast("bigint").alias("converters"),
        F.try_divide(F.col("converters"), F.col("users")).alias("conversion_rate"),
    )
