"""Sequential testing of an experiment that is looked at every day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .experiments import CELL_COLUMNS, DEFAULT_ALPHA

#: Standard deviation of the effects that the test is tuned to (a conversion rate's
#: difference); any value keeps the error rate, a fitting one stops soonest.
EFFECT_SD = 0.02
#: Users that each group must have before a day is a look.
FIRST_LOOK = 30


def sequential_test(cells: DataFrame, day: str, keys: list[str] | None = None, alpha: float = DEFAULT_ALPHA,
                    effect_sd: float = EFFECT_SD, first_look: int = FIRST_LOOK) -> DataFrame:
    """One row per day with the running totals, the test and a stop flag.

    ``cells`` holds each day's own ``a_success, a_total, b_success, b_total`` (null
    = none), one row per day of each experiment (``keys``).  The statistic is the
    mixture sequential probability ratio test for a difference of rates: with the
    running difference d, its pooled variance V and effects mixed as N(0, s^2),
    the ratio sqrt(V / (V + s^2)) exp(d^2 s^2 / (2 V (V + s^2))) exceeds 1 / alpha on
    any look with probability alpha at most when there is no effect.  So the test
    may be read every day, and stopped at the first crossing:

    * ``z`` = d / sqrt(V), ``bound`` = the |z| that crosses on this day;
    * ``p_always`` = the smallest 1 / ratio so far, valid at any stopping time;
    * ``stop`` = crossed on this day or before.

    A day is no look (``valid`` false, null ``z`` and ``bound``) before each group has
    ``first_look`` users or while V is 0; ``p_always`` and ``stop`` then keep their
    last values (1 and false at first).  Days sort ascending; a null day comes first.

    The window runs over one row per day of an experiment, after all aggregation.
    """
    keys = list(keys or [])
    so_far = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(day)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = cells.select(*keys, day, *[
        F.sum(F.coalesce(F.col(c), F.lit(0)).cast("bigint")).over(so_far).alias(c) for c in CELL_COLUMNS])
    a_s, a_n, b_s, b_n = (F.col(c) for c in CELL_COLUMNS)
    pooled = F.try_divide(a_s + b_s, a_n + b_n)
    rows = rows.withColumn("_v", pooled * (F.lit(1.0) - pooled) * (
        F.try_divide(F.lit(1.0), a_n) + F.try_divide(F.lit(1.0), b_n)))
    look = (a_n >= first_look) & (b_n >= first_look) & (F.col("_v") > 0)
    rows = rows.withColumn("valid", F.coalesce(look, F.lit(False))).withColumn(
        "uplift", F.try_divide(b_s, b_n) - F.try_divide(a_s, a_n))
    v, s2 = F.col("_v"), F.lit(float(effect_sd) ** 2)
    rows = rows.withColumn("z", F.when(F.col("valid"), F.col("uplift") / F.sqrt(v)))
    half_log = F.log((v + s2) / v) / 2
    log_ratio = F.col("z") * F.col("z") * s2 / ((v + s2) * 2) - half_log
    bound = F.sqrt((v + s2) * 2 / s2 * (half_log - F.log(F.lit(float(alpha)))))
    rows = rows.withColumn("bound", F.when(F.col("valid"), bound)).withColumn(
        "_p", F.when(F.col("valid"), F.least(F.exp(-log_ratio), F.lit(1.0))))
    rows = rows.withColumn("p_always", F.coalesce(F.min("_p").over(so_far), F.lit(1.0)))
    crossed = F.max((F.abs("z") >= F.col("bound")).cast("int")).over(so_far)
    return rows.select(*keys, day, *CELL_COLUMNS, "uplift", "z", "bound", "p_always",
                       (F.coalesce(crossed, F.lit(0)) == 1).alias("stop"), "valid")
