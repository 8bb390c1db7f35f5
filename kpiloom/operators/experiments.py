"""A/B experiment statistics on a table of experiment cells.

The original computes on four integers in a web handler.  Here every statistic
is a Column expression over a DataFrame with one row per experiment (or per
segment), so the test runs where the metrics are, for any number of
experiments, without a driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_1df_sf, norm_two_sided_p

# Fixed values of the original procedure.
DEFAULT_ALPHA = 0.05
CI_Z = 1.96                 # the interval is always 95 %, whatever alpha is
SRM_THRESHOLD = 0.001       # SRM passes when its p-value is above this
NULL_EFFECT_PP = 1.0        # "expected null" needs |uplift| below 1 percentage point

CELL_COLUMNS = ["a_success", "a_total", "b_success", "b_total"]
RESULT_COLUMNS = ["a_rate", "b_rate", "uplift", "z", "p_value", "ci_low", "ci_high",
                  "srm_chi2", "srm_p", "significant", "valid"]


# -- E1..E3 -------------------------------------------------------------------

def ab_pivot(metrics: DataFrame, keys: list[str] | None = None,
             a: str = "A", b: str = "B") -> DataFrame:
    """Group rows -> one row per experiment: ``a_success, a_total, a_rate`` and
    the same for B.  ``keys`` are segment columns (none = one experiment)."""
    keys = list(keys or [])
    g = F.col("ab_group")

    def pick(label: str, col: str) -> Column:
        return F.max(F.when(g == label, F.col(col)))

    agg = metrics.groupBy(*keys).agg(
        pick(a, "converters").cast("bigint").alias("a_success"),
        pick(a, "users").cast("bigint").alias("a_total"),
        pick(a, "conversion_rate").alias("a_rate"),
        pick(b, "converters").cast("bigint").alias("b_success"),
        pick(b, "users").cast("bigint").alias("b_total"),
        pick(b, "conversion_rate").alias("b_rate"),
    )
    return agg


def ab_uplift(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Absolute (B - A) and relative ((B - A) / A, null when A = 0) uplift of the
    conversion rate."""
    keys = list(keys or [])
    g = F.col("ab_group")
    r = metrics.groupBy(*keys).agg(
        F.max(F.when(g == "A", F.col("conversion_rate"))).alias("cr_A"),
        F.max(F.when(g == "B", F.col("conversion_rate"))).alias("cr_B"),
    )
    return r.select(*keys, "cr_A", "cr_B",
                    (F.col("cr_B") - F.col("cr_A")).alias("abs_uplift"),
                    F.try_divide(F.col("cr_B") - F.col("cr_A"), F.col("cr_A")).alias("rel_uplift"))


def ab_bucket_share(groups: DataFrame) -> DataFrame:
    """Share of all assigned users in A and in B."""
    n = F.count(F.lit(1))
    return groups.agg(
        F.try_divide(F.count_if(F.col("ab_group") == "A"), n).alias("share_A"),
        F.try_divide(F.count_if(F.col("ab_group") == "B"), n).alias("share_B"),
    )


# -- E4..E10 ------------------------------------------------------------------

def ab_test(cells: DataFrame, alpha: float | str = DEFAULT_ALPHA, strict: bool = False) -> DataFrame:
    """Two-proportion z-test with pooled standard error, SRM check and CI.

    Adds ``a_rate, b_rate`` (success / total), ``uplift`` (b - a), ``z``,
    ``p_value`` (two-sided), ``ci_low/ci_high`` (uplift -/+ 1.96 pooled SE; 95 %
    whatever ``alpha`` is, as in the original), ``srm_chi2`` / ``srm_p``
    (chi-square, 1 df, against a 50/50 split), ``significant`` (p < alpha) and
    ``valid``.

    The SRM check depends on the totals alone, so it is given wherever both are
    positive.  The other statistics need a positive pooled variance: cells that are
    not numbers, a total <= 0, or a pooled rate outside (0, 1) (nobody or everybody
    converted) get nulls there and ``valid = false``; the original raises on them.
    A success count above its own total is computed like any other, as there.  ``strict=True`` raises a
    ``ValueError`` when any row is invalid (one count, no collect of rows).
    ``alpha`` is a number or the name of a per-row column.
    """
    # text that is not a number becomes null -> invalid row; a fractional double is truncated
    a_s, a_n, b_s, b_n = (F.col(c).try_cast("bigint") for c in CELL_COLUMNS)
    alpha_c = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    totals_ok = (a_n > 0) & (b_n > 0)
    n = a_n + b_n
    pooled = F.try_divide(a_s + b_s, n)
    var = pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), a_n) + F.try_divide(F.lit(1.0), b_n))
    pre_ok = totals_ok & (var > 0)
    se = F.when(pre_ok, F.sqrt(var))
    valid = F.coalesce(pre_ok & (se > 0), F.lit(False))

    a_rate = F.when(totals_ok, F.try_divide(a_s, a_n))
    b_rate = F.when(totals_ok, F.try_divide(b_s, b_n))
    out = cells.withColumn("_se", se).withColumn("valid", valid).withColumn(
        "a_rate", a_rate).withColumn("b_rate", b_rate)
    v = F.col("valid")
    uplift = F.col("b_rate") - F.col("a_rate")
    expected = n / F.lit(2.0)
    chi2 = F.pow(a_n - expected, 2) / expected + F.pow(b_n - expected, 2) / expected
    out = (out
           .withColumn("uplift", F.when(v, uplift))
           .withColumn("z", F.when(v, uplift / F.col("_se")))
           .withColumn("srm_chi2", F.when(totals_ok, chi2)))
    out = (out
           .withColumn("p_value", F.when(v, norm_two_sided_p(F.col("z"))))
           .withColumn("ci_low", F.when(v, F.col("uplift") - F.lit(CI_Z) * F.col("_se")))
           .withColumn("ci_high", F.when(v, F.col("uplift") + F.lit(CI_Z) * F.col("_se")))
           .withColumn("srm_p", chi2_1df_sf(F.col("srm_chi2"))))
    out = out.withColumn("significant", F.when(v, F.col("p_value") < alpha_c)).drop("_se")
    rest = [c for c in out.columns if c not in CELL_COLUMNS + RESULT_COLUMNS]
    out = out.select(*rest, "a_success", "a_total", "b_success", "b_total", *RESULT_COLUMNS)
    if strict:
        bad = out.filter(~F.col("valid")).limit(1).count()
        if bad:
            raise ValueError("invalid experiment cells: totals and the pooled standard error must be > 0")
    return out


# -- E11, E12 -----------------------------------------------------------------

def ab_verdict(results: DataFrame, srm_threshold: float = SRM_THRESHOLD,
               null_pp: float = NULL_EFFECT_PP) -> DataFrame:
    """SRM status ('PASS' when srm_p > threshold, else 'FAIL') and the verdict:
    'EXPECTED' (a null finding: not significant and |uplift| < ``null_pp``
    percentage points) or 'UNEXPECTED'.  Invalid rows get nulls."""
    v = F.col("valid")
    expected_null = (~F.col("significant")) & (F.abs(F.col("uplift") * 100.0) < F.lit(null_pp))
    return results.select(
        "*",
        F.when(F.col("srm_p").isNotNull(), F.when(F.col("srm_p") > srm_threshold, "PASS").otherwise("FAIL"))
        .alias("srm_status"),
        F.when(v, expected_null).alias("expected_null"),
        F.when(v, F.when(expected_null, "EXPECTED").otherwise("UNEXPECTED")).alias("verdict"),
    )


# -- E13 ----------------------------------------------------------------------

def run_experiment(users: DataFrame, events: DataFrame, orders: DataFrame,
                   alpha: float = DEFAULT_ALPHA, method: str = "md5") -> DataFrame:
    """Funnel + assignment -> group metrics -> one row of cells -> z-test, SRM and
    verdict, as one logical plan."""
    from .assignment import ab_metrics_from_users
    metrics = ab_metrics_from_users(users, events, orders, method=method)
    return ab_verdict(ab_test(ab_pivot(metrics), alpha))
