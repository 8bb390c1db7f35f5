"""Declarative data-quality tests on gold models, a one-pass suite runner and
the gate that stops training when a test fails."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NotNull:
    """Fails when any value of ``column`` is null."""
    model: str
    column: str
    name: str = field(default="not_null", init=False)

    def failures(self) -> Column:
        return F.count_if(F.col(self.column).isNull())


@dataclass(frozen=True)
class AcceptedValues:
    """Fails when a non-null value of ``column`` is outside ``values`` (nulls pass)."""
    model: str
    column: str
    values: tuple
    name: str = field(default="accepted_values", init=False)

    def failures(self) -> Column:
        c = F.col(self.column)
        return F.count_if(c.isNotNull() & ~c.isin(*self.values))


# The gold suite, 9 not-null and 2 accepted-values tests.
GOLD_TESTS = (
    NotNull("revenue_daily", "day"),
    NotNull("funnel_users", "user_id"),
    AcceptedValues("funnel_users", "converted", (True, False)),
    NotNull("ab_group", "user_id"),
    NotNull("ab_group", "ab_group"),
    NotNull("ab_metrics", "ab_group"),
    NotNull("ab_metrics", "users"),
    NotNull("retention_weekly", "cohort_week"),
    NotNull("retention_weekly", "week_n"),
    NotNull("features_conversion", "user_id"),
    AcceptedValues("features_conversion", "will_convert_14d", (0, 1)),
)



@dataclass(frozen=True)
class Relationship:
    """Fails when a non-null ``column`` of ``model`` is no value of ``to_column`` of ``to_model``."""
    model: str
    column: str
    to_model: str
    to_column: str


# The foreign keys of the silver tables.
SILVER_RELATIONSHIPS = (
    Relationship("orders", "user_id", "users", "id"),
    Relationship("order_items", "order_id", "orders", "order_id"),
    Relationship("events", "user_id", "users", "id"),
)


def orphans(child: DataFrame, column: str, parent: DataFrame, to_column: str) -> DataFrame:
    """``(key, n)``: the keys of ``child`` that ``parent`` lacks, with their rows.

    Nulls point nowhere and pass.  Rows are counted per key before the join (a map-side
    partial aggregate first), so an orphan key with a third of all rows is one row of
    it; the join is an anti join of different keys.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(F.col(to_column).alias("key")), "key", "left_anti")


def run_relationships(tables: dict[str, DataFrame], tests=SILVER_RELATIONSHIPS) -> DataFrame:
    """One row per test: ``(test_id, model, column, test, failures, passed, to_model,
    orphan_keys)``; ``failures`` counts rows, ``orphan_keys`` different keys."""
    out = None
    for i, t in enumerate(tests):
        for name in (t.model, t.to_model):
            if name not in tables:
                raise KeyError(f"no table named {name!r} for the relationship tests")
        counts = orphans(tables[t.model], t.column, tables[t.to_model], t.to_column).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("failures"), F.count(F.lit(1)).alias("orphan_keys"))
        row = counts.select(F.lit(i).alias("test_id"), F.lit(t.model).alias("model"), F.lit(t.column).alias("column"),
                            F.lit("relationship").alias("test"), "failures", (F.col("failures") == 0).alias("passed"),
                            F.lit(t.to_model).alias("to_model"), "orphan_keys")
        out = row if out is None else out.unionByName(row)
    return out


#: Trailing days that a metric's bounds are drawn from, fewest of them with a value, and
#: half width of the bounds in robust standard deviations (1.4826 median deviations).
BOUND_DAYS, BOUND_LEAST, BOUND_WIDTH = 28, 7, 5.0
MAD_TO_SD = 1.4826


def metric_bounds(rows: DataFrame, day: str, metrics: list[str], days: int = BOUND_DAYS, least: int = BOUND_LEAST,
                  width: float = BOUND_WIDTH) -> DataFrame:
    """``(metric, day, value, n, median, mad, low, high, flagged)``: every value of the
    daily ``metrics`` against the ``days`` calendar days before it.

    The frame is one of time, not of rows, so missing days shorten it.  Median and
    median absolute deviation are exact (a frame holds ``days`` values).  With
    fewer than ``least`` values behind it, or a null value, a day has null bounds and
    is not flagged; a history without any spread allows its median only.  A null day
    is left out.
    """
    cells = rows.where(F.col(day).isNotNull()).select(F.col(day).alias("day"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_c"))
    cells = cells.select("_c.metric", "day", "_c.value").withColumn("_n", F.unix_date("day"))
    behind = Window.partitionBy("metric").orderBy("_n").rangeBetween(-days, -1)

    def middle(values: Column) -> Column:
        def of(s: Column) -> Column:
            n = F.size(s)
            return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
        return F.get(F.transform(F.array(F.array_sort(values)), of), F.lit(0))

    got = cells.withColumn("_past", F.collect_list("value").over(behind)).withColumn("n", F.size("_past").cast("bigint"))
    got = got.withColumn("median", F.when(F.col("n") >= least, middle(F.col("_past"))))
    away = F.transform("_past", lambda x: F.abs(x - F.col("median")))
    got = got.withColumn("mad", F.when(F.col("n") >= least, middle(away)))
    reach = F.col("mad") * F.lit(width * MAD_TO_SD)
    got = got.withColumns({"low": F.col("median") - reach, "high": F.col("median") + reach})
    flagged = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return got.select("metric", "day", "value", "n", "median", "mad", "low", "high",
                      F.coalesce(flagged, F.lit(False)).alias("flagged"))


def run_suite(spark: SparkSession, models: dict[str, DataFrame], tests=GOLD_TESTS,
              only: str | None = None) -> DataFrame:
    """Evaluate every test; all tests of one model run in a single aggregate, so
    each model is scanned once however many tests it has.  The report has one
    row per test: ``(test_id, model, column, test, failures, passed)``.  ``only`` names one
    kind of test; models without such a test are not built."""
    by_model: dict[str, list[tuple[int, object]]] = {}
    for i, t in enumerate(tests):
        if only is not None and t.name != only:
            continue
        by_model.setdefault(t.model, []).append((i, t))
    parts = []
    for model, items in by_model.items():
        if model not in models:
            raise KeyError(f"no model named {model!r} for the quality suite")
        counts = models[model].agg(*[t.failures().alias(f"t{i}") for i, t in items])
        rows = F.array(*[
            F.struct(F.lit(i).alias("test_id"), F.lit(t.model).alias("model"), F.lit(t.column).alias("column"),
                     F.lit(t.name).alias("test"), F.col(f"t{i}").cast("bigint").alias("failures"))
            for i, t in items])
        parts.append(counts.select(F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("test_id", "model", "column", "test", "failures",
                      (F.col("failures") == 0).alias("passed"))


class QualityGateError(RuntimeError):
    pass


def gate(report: DataFrame) -> list:
    """Raise :class:`QualityGateError` when any test failed; return the report rows.

    The report is one row per test (a fixed, small number), so collecting it is
    bounded.
    """
    rows = report.orderBy("test_id").collect()
    failed = [r for r in rows if not r["passed"]]
    if failed:
        desc = ", ".join(f"{r['model']}.{r['column']} {r['test']} ({r['failures']} failures)" for r in failed)
        raise QualityGateError(f"{len(failed)} data test(s) failed: {desc}")
    return rows
