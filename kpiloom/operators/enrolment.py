"""Many experiments at once, from a table of experiment metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket
from .experiments import DEFAULT_ALPHA, ab_pivot, ab_test
from .revenue import COMPLETE
from .skew import salted_key_join

#: Buckets of an assignment.
BUCKETS = 100


def enrolled(users: DataFrame, events: DataFrame, experiments: DataFrame, method: str = "md5") -> DataFrame:
    """``(experiment, user_id, first_event, ends, ab_group)``: every user in every
    experiment whose interval [starts, ends) holds the user's first event.

    ``experiments`` has ``experiment, starts, ends, share_a, salt`` (times, percent of A,
    text).  The salt makes the assignments of different experiments independent.  Rows
    with a null or empty interval enrol nobody; a null salt is the experiment's name.

    The events are read once, reduced to one row per user by a partial aggregate.  The
    interval join goes by day: an experiment stands once for each of its days, a user for
    the day of the first event, and days are joined by equality, then the times compared.
    So N experiments cost one scan, and users meet only experiments of their day.
    """
    ids = users.where(F.col("id").isNotNull()).select(F.col("id").alias("user_id")).distinct()
    first = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("created_at").alias("first_event"))
    seen = ids.join(first, "user_id").withColumn("_day", F.col("first_event").cast("date"))
    running = experiments.where(F.col("starts") < F.col("ends")).select(
        "experiment", "starts", "ends", "share_a", F.coalesce("salt", "experiment").alias("_salt"),
        F.explode(F.sequence(F.col("starts").cast("date"), F.col("ends").cast("date"))).alias("_day"))
    rows = seen.join(running, "_day").where(
        (F.col("first_event") >= F.col("starts")) & (F.col("first_event") < F.col("ends")))
    in_a = bucket("user_id", BUCKETS, method, F.col("_salt")) < F.col("share_a")
    return rows.select("experiment", "user_id", "first_event", "ends",
                       F.when(in_a, F.lit("A")).otherwise(F.lit("B")).alias("ab_group"))


def experiment_board(users: DataFrame, events: DataFrame, orders: DataFrame, experiments: DataFrame,
                     alpha: float = DEFAULT_ALPHA, complete: str = COMPLETE, method: str = "md5") -> DataFrame:
    """One row per experiment with an enrolled user: cells and test (:func:`ab_test`).

    A user converts in an experiment by a completed order at or after the first event
    and before the experiment's end.  As the first event is the user's own, one time
    decides for all experiments: the user's first completed order from then on.  Orders
    meet the first events in a join that splits hot users.
    """
    rows = enrolled(users, events, experiments, method)
    first = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("created_at").alias("first_event"))
    bought = orders.where((F.col("status") == complete) & F.col("created_at").isNotNull()).select("user_id", "created_at")
    after = salted_key_join(bought, first, "user_id", counts_from=orders).where(
        F.col("created_at") >= F.col("first_event"))
    converted = after.groupBy("user_id").agg(F.min("created_at").alias("first_order"))
    joined = rows.join(converted, "user_id", "left")
    hit = F.coalesce(F.col("first_order") < F.col("ends"), F.lit(False))
    metrics = joined.groupBy("experiment", "ab_group").agg(
        F.count(F.lit(1)).alias("users"), F.count_if(hit).alias("converters"))
    metrics = metrics.withColumn("conversion_rate", F.try_divide("converters", "users"))
    return ab_test(ab_pivot(metrics, keys=["experiment"]), alpha)
