"""Conversion features: recency/frequency/monetary, traffic-source mix and a
forward-looking 14-day conversion label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_days, full_days_between
from ..functions.money import money_sum, rest_sum, units_to_double, zero_units
from .skew import left_join_nulls_aside, salted_key_join

# Fixed values of the model.
LOOKBACK_DAYS = 30
LABEL_DAYS = 14
SOURCES = {"pct_email": "Email", "pct_direct": "Direct", "pct_organic": "Organic",
           "pct_ads": "Ads", "pct_social": "Social"}

# -- K7a + K7c: one pass over events ----------------------------------------

def event_profile(events: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """Per user (null user included): ``anchor_ts`` = last event time, ``n_events``
    and one count per traffic source.  Last event and source mix share this one
    aggregate (a map-side partial aggregate first: a hot user is one row per
    map task)."""
    sources = SOURCES if sources is None else sources
    return events.groupBy("user_id").agg(
        F.max("created_at").alias("anchor_ts"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col("traffic_source") == s).alias(f"n_{k}") for k, s in sources.items()],
    )


def last_event(events: DataFrame) -> DataFrame:
    """K7a: ``(user_id, anchor_ts)``, the last event time per user."""
    return events.groupBy("user_id").agg(F.max("created_at").alias("anchor_ts"))


def _shares(sources: dict[str, str]) -> list[Column]:
    return [F.try_divide(F.col(f"n_{k}"), F.col("n_events")).alias(k) for k in sources]


def source_mix(events: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """K7c: share of a user's events per named source.  Other sources only enter
    the denominator, so shares may sum to less than 1."""
    sources = SOURCES if sources is None else sources
    p = event_profile(events, sources)
    return p.select("user_id", *_shares(sources))


# -- K7b + K7d: one pass over orders ------------------------------------------

def order_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order row with its item-row count and exact price sum.

    The original joins users -> orders -> items and aggregates the fan-out; the
    fan-out is reproduced arithmetically instead: an order stands for
    ``greatest(n_items, 1)`` rows of the left join, and its price sum is null
    when it has no (priced) item, exactly what a SUM over those rows gives.
    Items are partially aggregated before their shuffle, so an order with many
    items cannot skew the join.
    """
    per_order = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        money_sum("sale_price").alias("price_sum"),
        rest_sum("sale_price").alias("price_rest"),
    )
    return left_join_nulls_aside(orders.select("order_id", "user_id", "created_at"), per_order, "order_id")


def order_activity(
    orders: DataFrame,
    items: DataFrame,
    anchors: DataFrame,
    lookback_days: int = LOOKBACK_DAYS,
    label_days: int = LABEL_DAYS,
) -> DataFrame:
    """One row per row of ``anchors`` (per user, null user included) with the
    in-window order aggregates, the label count, and every other column of
    ``anchors`` passed through:

    * ``orders_30d`` = item rows of orders at or after ``anchor - 30 d`` (there is
      no upper bound: orders after the anchor count too, as in the original);
    * ``revenue_30d_units`` = their price sum (null when every in-window row is
      unpriced, 0 contributions from out-of-window rows);
    * ``frequency_30d`` = distinct in-window order ids;
    * ``label_orders`` = orders (any status) in ``(anchor, anchor + 14 d]``;
    * ``order_rows`` = order rows of the user (0 = no orders).

    Plan: orders (one row per order after the item pre-aggregate) are joined to
    the anchors on ``user_id``, keeping every anchor row, with hot users salted
    over several tasks (:func:`kpiloom.operators.skew.salted_key_join`); the
    per-user aggregate combines the pieces map-side, and the distinct count is
    planned as (user, order) partial aggregates before the final per-user one.
    Because the anchor rows survive the join, a caller that passes its whole
    per-user table gets it back aggregated once, with no second join.
    """
    lines = order_lines(orders, items).withColumn("_hit", F.lit(True))
    extra = [c for c in anchors.columns if c != "user_id"]
    j = salted_key_join(lines, anchors, "user_id", counts_from=orders, how="right")
    hit = F.col("_hit").isNotNull()                     # false on an anchor row without orders
    ts = F.col("created_at")
    after_start = ts >= (F.col("anchor_ts") - F.make_dt_interval(F.lit(lookback_days)))
    in_window = hit & after_start
    in_label = hit & (ts > F.col("anchor_ts")) & (ts <= add_days("anchor_ts", label_days))
    weight = F.greatest(F.coalesce(F.col("n_items"), F.lit(0)), F.lit(1))
    return j.groupBy("user_id").agg(
        F.sum(F.when(in_window, weight).otherwise(F.lit(0))).alias("orders_30d"),
        # an anchor row without orders contributes null (ignored), an order row 0 or its price sum
        F.sum(F.when(hit, F.when(after_start, F.col("price_sum")).otherwise(zero_units())))
        .alias("revenue_30d_units"),
        F.sum(F.when(hit & after_start, F.col("price_rest"))).alias("revenue_30d_rest"),
        F.count_distinct(F.when(in_window, F.col("order_id"))).alias("frequency_30d"),
        F.count_if(in_label).alias("label_orders"),
        F.count_if(hit).alias("order_rows"),
        *[F.first(c).alias(c) for c in extra],
    )


def rfm(users: DataFrame, orders: DataFrame, items: DataFrame, anchors: DataFrame,
        lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """K7b: ``(user_id, days_since_signup, orders_30d, revenue_30d, frequency_30d)``
    for users with at least one event (inner join to the anchors).

    ``days_since_signup`` = whole 24 h periods from signup to the anchor.  A user
    without orders gets 0 / 0 / 0; a user whose only in-window order has no item
    gets orders 1 and revenue null.  Duplicate user rows are grouped by
    ``(user_id, days_since_signup)`` like the original ``GROUP BY 1, 2``: their
    order counts add up and the distinct count does not.
    """
    act = order_activity(orders, items, anchors.select("user_id", "anchor_ts"), lookback_days)
    return _rfm_from(users, act)


def _rfm_from(users: DataFrame, act: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Users joined (inner) to the per-user order aggregate, grouped by
    (user_id, days_since_signup).  ``carry`` are per-user columns of ``act``
    passed through unchanged (functionally dependent on ``user_id``)."""
    carry = list(carry or [])
    u = users.select(F.col("id").alias("user_id"), "created_at")
    j = u.hint("merge").join(act, "user_id", "inner")      # grows with the users: not hashed by the driver
    has_orders = F.col("order_rows") > 0
    per_row = j.select(
        "user_id",
        full_days_between("anchor_ts", "created_at").alias("days_since_signup"),
        "orders_30d",
        F.when(has_orders, F.col("revenue_30d_units")).otherwise(zero_units()).alias("revenue_30d_units"),
        "revenue_30d_rest",
        "frequency_30d",
        *carry,
    )
    # grouping on (user_id, days) is satisfied by the join's user_id partitioning:
    # no extra shuffle
    g = per_row.groupBy("user_id", "days_since_signup").agg(
        F.sum("orders_30d").alias("orders_30d"),
        F.sum("revenue_30d_units").alias("revenue_30d_units"),
        F.sum("revenue_30d_rest").alias("revenue_30d_rest"),
        F.max("frequency_30d").alias("frequency_30d"),
        *[F.first(c).alias(c) for c in carry],
    )
    return g.select(
        "user_id", "days_since_signup",
        F.col("orders_30d").cast("bigint").alias("orders_30d"),
        units_to_double("revenue_30d_units", "revenue_30d_rest").alias("revenue_30d"),
        F.col("frequency_30d").cast("bigint").alias("frequency_30d"),
        *carry,
    )


def conversion_label(anchors: DataFrame, orders: DataFrame, label_days: int = LABEL_DAYS) -> DataFrame:
    """K7d: ``(user_id, will_convert_14d)`` for every anchored user (null user
    included): 1 when the user has any order, of any status, in
    ``(anchor, anchor + 14 d]``.  Orders are joined onto the anchors with every
    anchor row kept (hot users salted), then counted per user."""
    o = orders.select("order_id", "user_id", "created_at").withColumn("_hit", F.lit(True))
    a = anchors.select("user_id", "anchor_ts")
    j = salted_key_join(o, a, "user_id", counts_from=orders, how="right")
    ts = F.col("created_at")
    in_label = F.col("_hit").isNotNull() & (ts > F.col("anchor_ts")) & (ts <= add_days("anchor_ts", label_days))
    return j.groupBy("user_id").agg((F.count_if(in_label) > 0).cast("bigint").alias("will_convert_14d"))


def features_conversion(users: DataFrame, orders: DataFrame, items: DataFrame, events: DataFrame,
                        sources: dict[str, str] | None = None,
                        lookback_days: int = LOOKBACK_DAYS, label_days: int = LABEL_DAYS) -> DataFrame:
    """K7: rfm ⟕ source mix ⋈ label, shares coalesced to 0, label 0/1.

    Plan: users, events and items are read once, orders twice (once more, by statistics
    alone where there are none, for rows without an order id), after one counting
    job on the order user ids that finds hot users.  One aggregate over events gives the
    anchor *and* the source counts; the orders are joined to that whole profile
    (profile rows kept, hot users salted) and one aggregate gives the 30-day
    features, the label and the profile back per user; users join last.  The
    users join and the final grouping share one hash partitioning on
    ``user_id``.
    """
    sources = SOURCES if sources is None else sources
    prof = event_profile(events, sources)
    counts = ["n_events"] + [f"n_{k}" for k in sources]
    act = order_activity(orders, items, prof, lookback_days, label_days)
    r = _rfm_from(users, act, carry=counts + ["label_orders"])
    return r.select(
        "user_id", "days_since_signup", "orders_30d", "revenue_30d", "frequency_30d",
        *[F.coalesce(F.try_divide(F.col(f"n_{k}"), F.col("n_events")), F.lit(0.0)).alias(k) for k in sources],
        (F.coalesce(F.col("label_orders"), F.lit(0)) > 0).cast("bigint").alias("will_convert_14d"),
    )
