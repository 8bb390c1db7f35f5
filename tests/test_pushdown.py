"""Filters and projections reach the Parquet scan."""

import datetime as dt

from pyspark.sql import functions as F

from kpiloom.operators import revenue as rev
from kpiloom.plans.reports import _page
from kpiloom.sources.tables import read_table

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_bound_reaches_the_orders_scan(spark):
    # an orders table whose created_at is a stored column (no derived stand-in)
    o = read_table(spark, SF_SMALL, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "Complete").otherwise("Other").alias("status"),
        F.col("o_orderdate").alias("created_at"))
    i = read_table(spark, SF_SMALL, "lineitem").select(F.col("l_orderkey").alias("order_id"),
                                                      F.col("l_extendedprice").alias("sale_price"))
    df = rev.revenue_daily(o, i).filter(F.col("day") >= F.lit(dt.date(1998, 1, 1)))
    df.collect()
    plan = _plan(df)
    scan = [line for line in plan.split("\n") if "o_orderdate" in line and "PushedFilters" in line]
    assert scan and "GreaterThanOrEqual(o_orderdate" in scan[0], plan
    # only the columns the model reads are scanned
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan or \
           "o_totalprice" not in plan


def test_page_is_a_top_k(spark):
    df = _page(spark.range(100000).withColumnRenamed("id", "user_id"), 10)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()
