"""Plan properties of every SQL-checkable report: JVM-side only, no cross joins."""

import datetime as dt
import re

import pytest

import __spark_entry__ as E
from kpiloom.plans.reports import run_report
from kpiloom.sources.silver import Sources

from .conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_plan_is_jvm_side_without_cross_joins(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()                                   # the final adaptive plan shows the codegen stages
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [op for op in FORBIDDEN if op in plan]
    assert not found, (name, found)
    assert "WholeStageCodegen" in plan or "*(" in plan


@pytest.mark.parametrize("name", ["funnel_users", "retention_weekly", "retention_unbounded", "features_conversion"])
def test_users_are_not_hashed_by_the_driver(spark, name):
    """Joined by shuffle, however few bytes they take."""
    at = dt.datetime(2024, 1, 3)
    src = Sources.from_tables(
        spark, spark.createDataFrame([(i, at) for i in range(20)], "id long, created_at timestamp_ntz"),
        spark.createDataFrame([(i, i, "Complete", at) for i in range(20)],
                              "order_id long, user_id long, status string, created_at timestamp_ntz"),
        spark.createDataFrame([(i, 1.5) for i in range(20)], "order_id long, sale_price double"),
        spark.createDataFrame([(i, "page_view", at, "Email") for i in range(0, 20, 2)],
                              "user_id long, event_type string, created_at timestamp_ntz, traffic_source string"))
    df = run_report(spark, name, src)
    assert df.count() and df.collect()
    joins = re.findall(r"(\w+Join) \[user_id#", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    assert joins and not [j for j in joins if j.startswith("Broadcast")]
