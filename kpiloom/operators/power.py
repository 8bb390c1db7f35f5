"""Power analysis of two-proportion tests, one row per experiment or segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.stats import norm_cdf, norm_ppf
from .experiments import DEFAULT_ALPHA

#: Power aimed at.
TARGET = 0.8
#: Halvings of the interval in which the minimal effect lies (2^-60 of it remains).
HALVINGS = 60


def power_at(rate: Column, effect: Column, n_a: Column, n_b: Column, alpha: float = DEFAULT_ALPHA) -> Column:
    """Power of the two-sided test when group A converts at ``rate`` and B at
    ``rate + effect``: the statistic is normal around effect / se with the groups' own
    variances, and is held against the pooled critical value."""
    z = norm_ppf(F.lit(1.0 - alpha / 2))

    def at(other: Column) -> Column:
        pooled = (rate * n_a + other * n_b) / (n_a + n_b)
        limit = z * F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
        se1 = F.sqrt(rate * (F.lit(1.0) - rate) / n_a + other * (F.lit(1.0) - other) / n_b)
        tails = [let(F.try_divide(side - limit, se1), norm_cdf) for side in (other - rate, rate - other)]
        return tails[0] + tails[1]

    return let(rate + effect, at)


def power_analysis(cells: DataFrame, alpha: float = DEFAULT_ALPHA, target: float = TARGET) -> DataFrame:
    """Adds to rows of ``a_success, a_total, b_success, b_total``:

    * ``a_rate`` and ``uplift`` as observed, ``power`` = the power at that uplift;
    * ``min_effect`` = the smallest rise over A's rate that is found with power
      ``target``, solved per row by halving (power rises with the effect); null when
      even a rise to 1 is not found so often;
    * ``users_needed`` = users per group to find the observed uplift with that power,
      for equal groups; null without an uplift.

    A total that is not positive, or a rate of A outside (0, 1), gives ``valid`` false
    and nulls; a rate of B at 0 or 1 is computed.
    """
    a_s, a_n, b_s, b_n = (F.col(c).try_cast("double") for c in ("a_success", "a_total", "b_success", "b_total"))
    rows = cells.withColumns({"_na": a_n, "_nb": b_n, "a_rate": F.when(a_n > 0, a_s / a_n),
                              "_b": F.when(b_n > 0, b_s / b_n)})
    ok = (F.col("a_rate") > 0) & (F.col("a_rate") < 1) & (F.col("_b") >= 0) & (F.col("_b") <= 1)
    rows = rows.withColumn("valid", F.coalesce(ok, F.lit(False)))
    v = F.col("valid")
    rate, na, nb = (F.when(v, F.col(c)) for c in ("a_rate", "_na", "_nb"))
    rows = rows.withColumn("a_rate", F.when(v, F.col("a_rate"))).withColumn(
        "uplift", F.when(v, F.col("_b") - F.col("a_rate")))

    def halve(at: Column, _step: Column) -> Column:
        middle = (at["low"] + at["high"]) / 2
        found = power_at(rate, middle, na, nb, alpha) >= target
        return F.struct(F.when(found, at["low"]).otherwise(middle).alias("low"),
                        F.when(found, middle).otherwise(at["high"]).alias("high"))

    widest = F.lit(1.0) - rate
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)),
                         F.struct(F.lit(0.0).alias("low"), widest.alias("high")), halve)["high"]
    reached = power_at(rate, widest, na, nb, alpha) >= target
    other = F.col("a_rate") + F.col("uplift")
    mean = (F.col("a_rate") + other) / 2
    spread = (norm_ppf(F.lit(1.0 - alpha / 2)) * F.sqrt(mean * (F.lit(1.0) - mean) * 2)
              + norm_ppf(F.lit(float(target))) * F.sqrt(
                  F.col("a_rate") * (F.lit(1.0) - F.col("a_rate")) + other * (F.lit(1.0) - other)))
    needed = F.ceil(F.try_divide(spread * spread, F.col("uplift") * F.col("uplift")))
    return rows.withColumns({
        "power": F.when(v, power_at(rate, F.col("uplift"), na, nb, alpha)),
        "min_effect": F.when(v & reached, solved),
        "users_needed": F.when(v, needed.cast("bigint")),
    }).drop("_na", "_nb", "_b").withColumn("valid", F.col("valid"))
