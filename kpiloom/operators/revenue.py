"""Daily revenue KPIs (two generations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_of, day_start
from ..functions.money import money_sum, rest_sum, units_to_double, zero_units

COMPLETE = "Complete"


def revenue_daily(orders: DataFrame, items: DataFrame, complete: str = COMPLETE) -> DataFrame:
    """Per calendar day: ``orders`` = completed *item rows* (as in the original
    model, despite its name), ``revenue`` = sum of completed item prices (0 when
    the day has none), ``aov`` = revenue / orders, null when orders = 0.

    Orders without items vanish (inner join); days whose orders are all
    non-complete are kept with 0 / 0 / null.

    Plan: the conditional aggregates cannot be pushed below the join (zero days
    must survive), so the join is a plain key join.  Items are pre-aggregated per
    order (count, exact sum) with a map-side partial aggregate first, so the join
    input is one row per order and an order with a huge number of items cannot
    skew it; the per-day aggregate is partial + final.
    """
    per_order_items = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        money_sum("sale_price").alias("price_sum"),
        rest_sum("sale_price").alias("price_rest"),
    )
    o = orders.select("order_id", day_of("created_at").alias("day"), "status")
    joined = o.join(per_order_items, "order_id", "inner")
    is_complete = F.col("status") == complete
    agg = joined.groupBy("day").agg(
        F.sum(F.when(is_complete, F.col("n_items")).otherwise(F.lit(0))).alias("orders"),
        F.sum(F.when(is_complete, F.col("price_sum")).otherwise(zero_units())).alias("revenue_units"),
        F.sum(F.when(is_complete, F.col("price_rest"))).alias("revenue_rest"),
        # an order whose items all have null price contributes no revenue but
        # its rows still count: keep "sum is null" only when every complete
        # item price on the day is null (as a plain SUM would)
    )
    return agg.select(
        "day",
        F.col("orders").cast("bigint").alias("orders"),
        units_to_double("revenue_units", "revenue_rest").alias("revenue"),
        F.try_divide(units_to_double("revenue_units", "revenue_rest"), F.nullif(F.col("orders"), F.lit(0))).alias("aov"),
    )


def revenue_daily_completed(orders: DataFrame, items: DataFrame, complete: str = COMPLETE) -> DataFrame:
    """First-generation daily revenue: filter completed orders first (days with no
    completed order vanish), ``day`` stays a midnight timestamp, ``orders`` =
    distinct order ids, ``revenue`` = sum of item prices, ``aov`` = average item
    price (nulls ignored).

    Plan: the status filter reaches the orders scan; items are pre-aggregated per
    order (count of priced items, exact sum) so the join is 1 row per order.
    ``count(distinct order_id)`` per day is computed as a distinct of
    (day, order_id) that Spark partially aggregates before the shuffle.
    """
    per_order_items = items.groupBy("order_id").agg(
        F.count("sale_price").alias("n_priced"),
        money_sum("sale_price").alias("price_sum"),
        rest_sum("sale_price").alias("price_rest"),
    )
    o = orders.filter(F.col("status") == complete).select("order_id", day_start("created_at").alias("day"))
    joined = o.join(per_order_items, "order_id", "inner")
    agg = joined.groupBy("day").agg(
        F.count_distinct("order_id").alias("orders"),
        F.sum("price_sum").alias("revenue_units"),
        F.sum("price_rest").alias("revenue_rest"),
        F.sum("n_priced").alias("n_priced"),
    )
    return agg.select(
        "day",
        F.col("orders").cast("bigint").alias("orders"),
        units_to_double("revenue_units", "revenue_rest").alias("revenue"),
        F.try_divide(units_to_double("revenue_units", "revenue_rest"), F.col("n_priced")).alias("aov"),
    )
