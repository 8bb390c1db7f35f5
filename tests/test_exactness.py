"""Whole inputs, exact values: what earlier versions cut, rounded or recomputed."""

import datetime as dt
import gc
import math
import random

import pytest
from pyspark.sql import functions as F

from kpiloom.__main__ import _params
from kpiloom.ml import prepare
from kpiloom.operators import experiments as exp
from kpiloom.operators import quality as dq
from kpiloom.operators import revenue as rev
from kpiloom.plans import reports
from kpiloom.sources import schemas
from kpiloom.sources.silver import Sources

from .conftest import SF_SMALL


def brute_thresholds(rows, fraction):
    out = {}
    for y in {y for y, _ in rows}:
        h = sorted(x for z, x in rows if z == y)
        t = h[max(1, math.ceil(fraction * len(h) - 1e-9)) - 1]
        if len(h) >= 2 and t >= h[-1]:
            t = max((x for x in h if x < h[-1]), default=t)
        out[y] = t
    return out


def test_split_thresholds_are_exact_and_independent_of_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 1]), rng.getrandbits(48)) for _ in range(3000)]
    rows += [(7, 5), (7, 5), (8, 1), (8, (1 << 48) - 1), (9, 3)]
    df = spark.createDataFrame(rows, "y long, _h long")
    want = brute_thresholds(rows, 0.8)
    for n in (3, 7, 16):
        assert prepare.split_thresholds(df.repartition(n), "y", 0.8) == want


def test_split_is_complete_and_disjoint(spark):
    df = spark.range(2000).select(F.col("id").alias("user_id"), (F.col("id") % 3).alias(prepare.TARGET))
    train, test = prepare.stratified_split(df)
    a, b = ({r.user_id for r in x.collect()} for x in (train, test))
    assert not a & b and len(a | b) == 2000 and abs(len(b) - 400) < 5


def test_null_labels_raise_with_their_number(spark):
    df = spark.createDataFrame([(i, None if i < 3 else i % 2) for i in range(50)], "user_id long, will_convert_14d long")
    with pytest.raises(ValueError, match="^3 row"):
        prepare.stratified_split(df)


def test_money_keeps_small_amounts_and_non_finite_prices(spark):
    day = dt.datetime(2024, 1, 1)
    orders = spark.createDataFrame([(1, 1, "Complete", day), (2, 1, "Complete", day + dt.timedelta(days=1)),
                                    (3, 1, "Complete", day + dt.timedelta(days=2))], schemas.SILVER_ORDERS)
    items = spark.createDataFrame([(1, 0.00004)] * 3 + [(2, float("nan")), (2, 1.5), (3, 1e15), (3, 0.25)], schemas.ORDER_ITEMS)
    for model in (rev.revenue_daily, rev.revenue_daily_completed):
        got = [r.revenue for r in model(orders, items).orderBy("day").collect()]
        assert got[0] == pytest.approx(0.00012) and math.isnan(got[1]) and got[2] == pytest.approx(1e15 + 0.25)


def test_range_without_bounds_is_everything(spark):
    rows = [tuple(r) for r in reports.run_report(spark, "revenue_daily", SF_SMALL).orderBy("day").collect()]
    assert [tuple(r) for r in reports.run_report(spark, "revenue_daily_range", SF_SMALL).collect()] == rows
    cut = reports.run_report(spark, "revenue_daily_range", SF_SMALL, {"start": rows[5][0], "end": rows[9][0]})
    assert [tuple(r) for r in cut.collect()] == rows[5:10]


def test_silver_keeps_every_source_column(spark):
    for name, table in (("silver_users", "customer"), ("silver_orders", "orders"),
                        ("silver_order_items", "lineitem"), ("silver_events", "events")):
        raw = spark.read.parquet(f"{SF_SMALL}/{table}.parquet")
        assert len(reports.run_report(spark, name, SF_SMALL).columns) >= len(raw.columns)
    users = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a@b")], "id long, created_at timestamp_ntz, email string")
    src = Sources.from_tables(spark, users, *(reports.run_report(spark, n, SF_SMALL) for n in (
        "silver_orders", "silver_order_items", "silver_events")))
    assert src.users.columns == ["id", "created_at", "email"]


def test_small_p_values_are_reported_whole(spark):
    cells = spark.createDataFrame([(100, 1000, 400, 1000), (0, 1000, 0, 100), (12, 10, 0, 100)],
                                  "a_success long, a_total long, b_success long, b_total long")
    rows = {r.a_success: r for r in exp.ab_test(cells).collect()}
    assert 0 < rows[100].p_value < 1e-40
    # the split of the totals is checked wherever there are totals
    assert not rows[0].valid and rows[0].srm_p < 1e-100 and rows[0].srm_chi2 == pytest.approx(736.3636, rel=1e-4)
    assert rows[12].valid and rows[12].z is not None


def test_text_coercion_reads_what_python_reads(spark):
    texts = ["1d", "1.5f", "0x1p3", " 2.5 ", "[3]", "1_0", "1e2", "+.5", "5.", "inf", "-Infinity", "nan", "", ".", "1__0", "١٢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(prepare.coerce_column(F.col("t"), df.schema["t"].dataType)).collect()]

    def want(t):
        t = t.strip()
        t = t[1:-1].strip() if t.startswith("[") and t.endswith("]") else t
        try:
            return float(t)
        except ValueError:
            return 0.0
    assert [repr(g) for g in got] == [repr(want(t)) for t in texts]


def test_only_models_with_a_wanted_test_are_built(spark):
    built = []

    class Models(dict):
        def __contains__(self, name):
            return True

        def __missing__(self, name):
            built.append(name)
            return spark.createDataFrame([(True, 1)], "converted boolean, will_convert_14d long")
    assert dq.run_suite(spark, Models(), only="accepted_values").count() == 2
    assert sorted(built) == ["features_conversion", "funnel_users"]


def test_pages_equal_the_sorted_model(spark):
    for name, page in (("funnel_users", "funnel_users_page"), ("features_conversion", "features_page")):
        whole = [tuple(r) for r in reports.run_report(spark, name, SF_SMALL).orderBy("user_id").limit(7).collect()]
        assert [tuple(r) for r in reports.run_report(spark, page, SF_SMALL, {"limit": 7}).collect()] == whole


def scans(df, table):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line and table in line for line in plan.splitlines())


def test_features_read_orders_at_most_twice(spark):
    for name in ("features_conversion", "features_rfm", "features_label"):
        df = reports.run_report(spark, name, SF_SMALL)
        assert scans(df, "o_orderkey") <= 2 and scans(df, "l_orderkey") <= 1, name


def test_sql_text_over_the_models(spark):
    got = reports.run_sql(spark, "select count(*) n from revenue_daily where day >= :first and orders > :least", SF_SMALL,
                          [{"name": "first", "type": "DATE", "value": "2024-01-01"}, {"name": "least", "type": "INT64", "value": 0}])
    days = reports.run_report(spark, "revenue_daily", SF_SMALL).where("day >= date'2024-01-01' and orders > 0").count()
    assert got.first().n == days
    assert reports.run_sql(spark, "select * from users", SF_SMALL).count() == 150


def test_parameters_may_hold_colons():
    got = {p["name"]: (p["type"], p["value"]) for p in _params(["a=DATE:2024-01-01", "b=x:y", "c=STRING:p:q", "d=null"])}
    assert got == {"a": ("DATE", "2024-01-01"), "b": ("STRING", "x:y"), "c": ("STRING", "p:q"), "d": ("STRING", None)}


def test_training_runs_belong_to_their_data(spark, monkeypatch):
    from kpiloom.plans import daily
    released = []

    class Run:
        def __init__(self, n):
            self.n = n

        def release(self):
            released.append(self.n)
    count = iter(range(100))
    monkeypatch.setattr(daily, "run_daily_batch", lambda *a, **k: ("report", Run(next(count))))
    tables = [reports.run_report(spark, n, SF_SMALL) for n in (
        "silver_users", "silver_orders", "silver_order_items", "silver_events")]
    for i in range(3):
        src = Sources.from_tables(spark, *tables)
        assert reports.training_run(src)[1].n == i == reports.training_run(src)[1].n
        del src
        gc.collect()
        assert released == list(range(i + 1))
    monkeypatch.setattr(reports, "_RUNS", {})
    a = reports.training_run(Sources(spark, SF_SMALL))
    assert reports.training_run(Sources(spark, SF_SMALL)) is a
