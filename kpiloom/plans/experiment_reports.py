"""Reports on experiments beyond the daily test: warehouse fingerprints, sequential
looks, power and exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_of
from ..functions.fingerprint import LONGEST, farm_fingerprint
from ..operators import assignment as asg
from ..operators import enrolment as enrol
from ..operators import experiments as exp
from ..operators import exposure as seen
from ..operators import guardrails as guard
from ..operators import power as pow_
from ..operators import sequential as seq
from ..sources.silver import Sources
from ..sources.tables import read_table
from .reports import report


@report("ab_group_fingerprint")
def _ab_group_fingerprint(src: Sources) -> DataFrame:
    """The assignment by the warehouse fingerprint, with the fingerprint."""
    groups = asg.assign("id", method="farm")
    return src.users.select(F.col("id").alias("user_id"), groups.alias("ab_group"),
                            farm_fingerprint(F.col("id").cast("string")).alias("fingerprint"))


@report("text_fingerprints")
def _text_fingerprints(src: Sources) -> DataFrame:
    """The fingerprint of every text column of users; null for a text too long for it."""
    texts = [f.name for f in src.users.schema.fields if isinstance(f.dataType, T.StringType)]
    short = [F.when(F.octet_length(c) <= LONGEST, F.col(c)) for c in texts]
    return src.users.select(F.col("id").alias("user_id"),
                            *[farm_fingerprint(s).alias(f"{c}_fingerprint") for c, s in zip(texts, short)])


def _daily_cells(src: Sources) -> DataFrame:
    m = asg.ab_metrics_from_users(src.users, src.events, src.orders, keys={"signup_day": day_of("created_at")})
    return exp.ab_pivot(m, keys=["signup_day"])


@report("ab_sequential")
def _ab_sequential(src: Sources, alpha: float = exp.DEFAULT_ALPHA) -> DataFrame:
    """The experiment as read at the end of every signup day."""
    return seq.sequential_test(_daily_cells(src), "signup_day", alpha=alpha)


@report("ab_power")
def _ab_power(src: Sources, alpha: float = exp.DEFAULT_ALPHA, target: float = pow_.TARGET) -> DataFrame:
    """Power, minimal effect and users needed per signup day."""
    cells = _daily_cells(src).select("signup_day", *exp.CELL_COLUMNS)
    return pow_.power_analysis(cells, alpha, target)


@report("ab_exposure")
def _ab_exposure(src: Sources, event: str = "page_view") -> DataFrame:
    """Assigned, exposed and converted users per group."""
    return seen.exposure_metrics(src.users, src.events, src.orders, event)


@report("ab_guardrails")
def _ab_guardrails(src: Sources, margin: float = guard.MARGIN, alpha: float = guard.ALPHA) -> DataFrame:
    """Revenue per order, events and orders per user: is B no worse than A?"""
    return guard.guardrail_test(guard.user_ratios(src.users, src.events, src.orders, src.items), margin, alpha)


def _planned_experiments(src: Sources) -> DataFrame:
    """Experiments of the test data, one per nation: staggered starts, 3 to 31 days long."""
    key = F.col("n_nationkey")
    starts = F.date_add(F.lit("2023-12-15").cast("date"), key.cast("int")).cast("timestamp_ntz")
    return read_table(src.spark, src.sf_dir, "nation").select(
        F.col("n_name").alias("experiment"), starts.alias("starts"),
        F.date_add(starts.cast("date"), (F.pmod(key, F.lit(5)) * 7 + 3).cast("int")).cast("timestamp_ntz").alias("ends"),
        F.lit(50).alias("share_a"), F.concat(F.lit("x"), key.cast("string")).alias("salt"))


@report("ab_experiment_board")
def _ab_experiment_board(src: Sources, experiments: DataFrame | None = None,
                         alpha: float = exp.DEFAULT_ALPHA) -> DataFrame:
    """All experiments of a metadata table (by default the test data's) in one pass."""
    known = _planned_experiments(src) if experiments is None else experiments
    return enrol.experiment_board(src.users, src.events, src.orders, known, alpha)
