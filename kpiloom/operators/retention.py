"""Weekly cohort retention (two generations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_start, weeks_between


def retention_weekly(
    users: DataFrame,
    events: DataFrame,
    week: str = "monday",
    bounds: tuple[int, int] | None = (0, 12),
    names: tuple[str, str] = ("week_n", "retention_rate"),
) -> DataFrame:
    """Cohort = week of signup; ``rate`` = distinct users active in week n of their
    cohort / users in the cohort.  Cohort size counts users that were never
    active; missing (cohort, n) pairs are not zero-filled.  ``bounds`` keeps
    ``n`` within a closed range (gold: 0..12); ``None`` keeps every n, negative
    ones included (first generation).

    Plan: events are reduced to distinct (user, week) before the join, so the
    join is users x active weeks, not users x events (a hot user contributes at
    most one row per week).  The join stays a shuffle join on ``user_id`` (both
    sides grow with the data; unhinted, users of few bytes a row in Parquet would be broadcast, and
    hashed in the driver's memory at many times their size).  Cohort sizes are one row per week; adaptive
    execution broadcasts them by their measured size.
    """
    week_col, rate_col = names
    cohorts = users.select(F.col("id").alias("user_id"), week_start("created_at", week).alias("cohort_week"))
    activity = (
        events.filter(F.col("user_id").isNotNull())
        .select("user_id", week_start("created_at", week).alias("activity_week"))
        .distinct()
    )
    joined = cohorts.hint("merge").join(activity, "user_id", "inner").select(
        "cohort_week", "user_id", weeks_between("activity_week", "cohort_week").alias(week_col)
    )
    if bounds is not None:
        joined = joined.filter(F.col(week_col).between(bounds[0], bounds[1]))
    active = joined.groupBy("cohort_week", week_col).agg(F.count_distinct("user_id").alias("active_users"))
    sizes = cohorts.groupBy("cohort_week").agg(F.count_distinct("user_id").alias("cohort_users"))
    return active.join(sizes, "cohort_week", "inner").select(
        "cohort_week",
        F.col(week_col),
        F.try_divide(F.col("active_users"), F.col("cohort_users")).alias(rate_col),
    )


def retention_unbounded(users: DataFrame, events: DataFrame) -> DataFrame:
    """First-generation retention: Sunday weeks, every week offset kept (negative
    ones too), columns ``week_number`` / ``retention``."""
    return retention_weekly(users, events, week="sunday", bounds=None, names=("week_number", "retention"))
