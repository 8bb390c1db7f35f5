"""Guardrail metrics: ratios per user that an experiment must not harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_sum, rest_sum, units_to_double
from ..functions.stats import norm_cdf
from .assignment import assign
from .revenue import COMPLETE

#: Relative loss that is still acceptable, and the error rate over all metrics together.
MARGIN = 0.05
ALPHA = 0.05


def user_ratios(users: DataFrame, events: DataFrame, orders: DataFrame, items: DataFrame,
                complete: str = COMPLETE) -> DataFrame:
    """``(user_id, metric, x, y)`` of every distinct user and metric, whose value in a
    group is sum(x) / sum(y): ``revenue_per_order`` (completed orders' item prices over
    completed orders), ``events_per_user`` and ``orders_per_user``.

    Events, orders and items are reduced to one row per user (items per order first)
    before they meet the users, so hot users are small.
    """
    ids = users.where(F.col("id").isNotNull()).select(F.col("id").alias("user_id")).distinct()
    n_events = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    prices = items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        money_sum("sale_price").alias("units"), rest_sum("sale_price").alias("rest"))
    done = orders.where((F.col("status") == complete) & F.col("user_id").isNotNull())
    bought = done.join(prices, "order_id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("units").alias("units"), F.sum("rest").alias("rest"))
    rows = ids.join(n_events, "user_id", "left").join(bought, "user_id", "left")
    zero = F.lit(0.0)
    n_orders = F.coalesce(F.col("n_orders").cast("double"), zero)
    revenue = F.coalesce(units_to_double("units", "rest"), zero)
    metrics = [("revenue_per_order", revenue, n_orders),
               ("events_per_user", F.coalesce(F.col("n_events").cast("double"), zero), F.lit(1.0)),
               ("orders_per_user", n_orders, F.lit(1.0))]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), x.alias("x"), y.alias("y")) for m, x, y in metrics])
    return rows.select("user_id", F.inline(each))


def guardrail_test(ratios: DataFrame, margin: float = MARGIN, alpha: float = ALPHA, share_a: int = 50,
                   method: str = "md5") -> DataFrame:
    """Per metric of ``(user_id, metric, x, y)`` rows, one per user: the ratios of both
    groups and a test of non-inferiority.

    With m = ``margin``, the hypothesis is B <= (1 - m) A; a small p-value says that B
    keeps more than that.  A ratio's variance is the delta method's, from the users'
    moments: (Vxx - 2 R Vxy + R^2 Vyy) / (n mean(y)^2).  ``p_holm`` is adjusted over the
    metrics (Holm), and ``safe`` says it is below ``alpha``.  A group without users or
    with sum(y) = 0, fewer than two users, or no variance at all gives a null test
    (``safe`` null), which counts for nothing in the adjustment.

    One partial aggregate over the users: two groups of a few sums per metric.
    """
    group = assign("user_id", share_a, method)
    moments = ratios.groupBy("metric", group.alias("g")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy"))
    r = F.try_divide("mx", "my")
    var = F.try_divide(F.col("vx") - r * F.col("cxy") * 2 + r * r * F.col("vy"), F.col("n") * F.col("my") * F.col("my"))
    of = moments.select("metric", "g", F.col("n").cast("bigint").alias("n"), r.alias("r"), var.alias("v"))
    pick = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c)))
    both = of.groupBy("metric").agg(*[pick(g, c).alias(f"{g.lower()}_{name}") for g in "AB" for c, name in (
        ("n", "users"), ("r", "ratio"), ("v", "var"))])
    kept = F.lit(1.0 - margin)
    se = F.sqrt(F.col("b_var") + kept * kept * F.col("a_var"))
    z = F.when(se > 0, F.try_divide(F.col("b_ratio") - kept * F.col("a_ratio"), se))
    tested = both.withColumn("z", z).withColumn("p_value", norm_cdf(-F.col("z")))
    # a few metrics: the windows run over one row each
    order = Window.partitionBy(F.col("p_value").isNull()).orderBy("p_value", "metric")
    every = Window.partitionBy(F.col("p_value").isNull())
    left = F.count(F.lit(1)).over(every) - F.row_number().over(order) + 1
    ranked = tested.withColumn("_step", F.col("p_value") * left)
    holm = F.least(F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(1.0))
    out = ranked.withColumn("p_holm", F.when(F.col("p_value").isNotNull(), holm))
    return out.select("metric", "a_users", "b_users", "a_ratio", "b_ratio",
                      (F.try_divide("b_ratio", "a_ratio") - 1).alias("lift"), "z", "p_value", "p_holm",
                      (F.col("p_holm") < F.lit(float(alpha))).alias("safe"))
