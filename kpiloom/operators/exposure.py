"""Exposure tracking: who saw an experiment, and who converted after that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import latest_state
from .assignment import assign
from .revenue import COMPLETE


def exposures(users: DataFrame, events: DataFrame, event: str = "page_view", limit: int | None = None) -> DataFrame:
    """``(user_id, exposed_at)``: each user's first ``event`` at or after an assignment
    (the signup of one of its rows).  Earlier events expose nobody."""
    assigned = users.select(F.col("id").alias("user_id"), "created_at", F.col("created_at").alias("assigned_at"))
    seen = events.where(F.col("event_type") == event).select("user_id", "created_at")
    shown = latest_state(seen, assigned, "user_id", "created_at", "assigned_at", limit)
    return shown.where("assigned_at is not null").groupBy("user_id").agg(F.min("created_at").alias("exposed_at"))


def exposure_metrics(users: DataFrame, events: DataFrame, orders: DataFrame, event: str = "page_view",
                     complete: str = COMPLETE, share_a: int = 50, method: str = "md5",
                     limit: int | None = None) -> DataFrame:
    """Per group: ``assigned`` users, ``exposed`` ones, ``converters`` (exposed users
    with a completed order at or after their exposure), ``early_converters`` (users
    with completed orders, none of them after an exposure), ``exposure_rate`` and
    ``conversion_rate`` (of the exposed; null when there are none).

    Users are distinct ids; a null id is no user.  The exposure is found by an as-of
    join (a user with a third of all events is split), and a user's orders are one
    row (their latest completed time) after a partial aggregate, so every join is
    one row per user.
    """
    ids = users.where(F.col("id").isNotNull()).select(F.col("id").alias("user_id")).distinct()
    bought = orders.where((F.col("status") == complete) & F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max("created_at").alias("last_order"), F.count(F.lit(1)).alias("_orders"))
    rows = ids.join(exposures(users, events, event, limit), "user_id", "left").join(bought, "user_id", "left")
    after = F.coalesce(F.col("last_order") >= F.col("exposed_at"), F.lit(False))
    out = rows.groupBy(assign("user_id", share_a, method).alias("ab_group")).agg(
        F.count(F.lit(1)).alias("assigned"), F.count("exposed_at").alias("exposed"),
        F.count_if(after).alias("converters"),
        F.count_if(F.col("_orders").isNotNull() & ~after).alias("early_converters"))
    return out.select("ab_group", "assigned", "exposed", "converters", "early_converters",
                      F.try_divide("exposed", "assigned").alias("exposure_rate"),
                      F.try_divide("converters", "exposed").alias("conversion_rate"))
