"""Per-user funnel flags (two generations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.silver import FIRST_GEN_STEPS
from .revenue import COMPLETE


def purchasers(orders: DataFrame, complete: str = COMPLETE) -> DataFrame:
    """Distinct users with at least one completed order (existence set)."""
    return orders.filter(F.col("status") == complete).select("user_id").distinct()


def _flag(cond) -> F.Column:
    # max(case when cond then 1 else 0 end) = 1; null conditions count as 0
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def funnel_users(
    users: DataFrame,
    events: DataFrame,
    orders: DataFrame,
    visit: str = "page_view",
    cart: str = "add_to_cart",
    complete: str = COMPLETE,
) -> DataFrame:
    """All distinct users with ``visited`` (any ``visit`` event), ``added_to_cart``
    (any ``cart`` event) and ``converted`` (any completed order).

    Plan: three user-keyed inputs, each reduced to one row per user with a
    partial aggregate before its shuffle (a user holding a third of all events
    becomes one row per map task), then two left joins on ``user_id`` that share
    one hash partitioning.
    """
    base = users.select(F.col("id").alias("user_id")).distinct()
    return _flags_for(base, events, orders, visit, cart, complete)


def user_rows(users: DataFrame, keys: dict[str, F.Column] | None = None) -> DataFrame:
    """``(user_id, *keys, n)``: each distinct user id (and segment) with its number of user rows."""
    by = [c.alias(k) for k, c in (keys or {}).items()]
    return users.groupBy(F.col("id").alias("user_id"), *by).agg(F.count(F.lit(1)).alias("n"))


def funnel_with_rows(users: DataFrame, events: DataFrame, orders: DataFrame, visit: str = "page_view",
                     cart: str = "add_to_cart", complete: str = COMPLETE,
                     keys: dict[str, F.Column] | None = None) -> DataFrame:
    """:func:`funnel_users` plus ``n``, the number of user rows per id: what a
    join of the funnel with a per-user-row table multiplies each user by."""
    return _flags_for(user_rows(users, keys), events, orders, visit, cart, complete)


def _flags_for(base: DataFrame, events: DataFrame, orders: DataFrame, visit: str, cart: str,
               complete: str) -> DataFrame:
    ev = events.groupBy("user_id").agg(
        _flag(F.col("event_type") == visit).alias("visited_flag"),
        _flag(F.col("event_type") == cart).alias("atc_flag"),
    )
    conv = purchasers(orders, complete).withColumn("_conv", F.lit(True))
    # both sides grow with the users: not hashed by the driver
    j = base.join(ev.hint("merge"), "user_id", "left").join(conv.hint("merge"), "user_id", "left")
    extra = [c for c in base.columns if c != "user_id"]
    return j.select(
        "user_id",
        (F.coalesce(F.col("visited_flag"), F.lit(0)) == 1).alias("visited"),
        (F.coalesce(F.col("atc_flag"), F.lit(0)) == 1).alias("added_to_cart"),
        F.col("_conv").isNotNull().alias("converted"),
        *extra,
    )


def funnel_event_set(
    events: DataFrame,
    orders: DataFrame,
    steps: dict[str, str] | None = None,
    type_col: str = "raw_event_type",
    complete: str = COMPLETE,
) -> DataFrame:
    """First-generation funnel: one row per user *with events* (the null user is a
    group of its own), a boolean per step = "the user's set of event types
    contains the step name", and ``converted`` as in :func:`funnel_users`.

    The original builds the distinct type set per user and tests membership;
    membership in ``collect_set`` equals a per-step any-match flag, which keeps
    the aggregate codegen'd and bounded (no per-user array).  Null types never
    match, so an all-null user gets false everywhere.
    """
    steps = dict(FIRST_GEN_STEPS if steps is None else steps)
    t = F.col(type_col)
    e = events.groupBy("user_id").agg(*[_flag(t == name).alias(out) for out, name in steps.items()])
    conv = purchasers(orders, complete).withColumn("_conv", F.lit(True))
    j = e.join(conv, "user_id", "left")
    return j.select(
        "user_id",
        *[(F.col(out) == 1).alias(out) for out in steps],
        F.col("_conv").isNotNull().alias("converted"),
    )


def event_type_sets(events: DataFrame, type_col: str = "raw_event_type") -> DataFrame:
    """Distinct non-null event types per user as an array (``collect_set``).

    Bounded by the event vocabulary, not by the number of events.
    """
    return events.groupBy("user_id").agg(F.array_sort(F.collect_set(type_col)).alias("events"))
