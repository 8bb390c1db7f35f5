import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from kpiloom.operators import quality as dq
from kpiloom.plans import reports
from kpiloom.plans.daily import run_daily_batch
from kpiloom.sources import catalog
from kpiloom.sources.silver import Sources

from .conftest import SF_SMALL


def test_gold_suite_passes(spark):
    rows = dq.gate(dq.run_suite(spark, reports.gold_models(Sources(spark, SF_SMALL))))
    assert len(rows) == 11 and all(r["passed"] for r in rows)


def test_poisoned_model_stops_the_gate(spark, tmp_path):
    models = reports.gold_models(Sources(spark, SF_SMALL))
    poisoned = models["funnel_users"].unionByName(
        spark.createDataFrame([(None, True, True, False)],
                              "user_id long, visited boolean, added_to_cart boolean, converted boolean"))
    models["funnel_users"] = poisoned
    report = dq.run_suite(spark, models)
    failed = {(r["model"], r["column"], r["test"]) for r in report.filter(~F.col("passed")).collect()}
    assert failed == {("funnel_users", "user_id", "not_null")}
    with pytest.raises(dq.QualityGateError):
        dq.gate(report)
    # accepted values: nulls pass, other values fail
    df = spark.createDataFrame([(0,), (1,), (None,), (2,)], "will_convert_14d long")
    r = dq.run_suite(spark, {"m": df}, [dq.AcceptedValues("m", "will_convert_14d", (0, 1))]).first()
    assert r["failures"] == 1


def test_gate_runs_before_training(spark, tmp_path, monkeypatch):
    calls = []
    real = dq.gate

    def failing_gate(report):
        calls.append("gate")
        raise dq.QualityGateError("poisoned")

    monkeypatch.setattr(dq, "gate", failing_gate)
    import kpiloom.plans.daily as pl
    monkeypatch.setattr(pl, "train_from_table", lambda *a, **k: calls.append("train"))
    with pytest.raises(dq.QualityGateError):
        run_daily_batch(spark, SF_SMALL, str(tmp_path / "run"))
    assert calls == ["gate"]
    monkeypatch.setattr(dq, "gate", real)


def test_run_report_errors_and_params(spark):
    with pytest.raises(ValueError):
        reports.run_report(spark, "", SF_SMALL)
    with pytest.raises(KeyError):
        reports.run_report(spark, "no_such_report", SF_SMALL)
    everything = reports.run_report(spark, "revenue_daily_range", SF_SMALL, {"start": None, "end": None})
    assert everything.count() == reports.run_report(spark, "revenue_daily", SF_SMALL).count()
    one = reports.run_report(spark, "revenue_daily_range", SF_SMALL,
                             {"start": dt.date(2024, 1, 5), "end": dt.date(2024, 1, 5), "unused": 1}).collect()
    assert [r["day"] for r in one] == [dt.date(2024, 1, 5)]


def test_catalog_lookup(spark):
    with pytest.raises(LookupError):
        catalog.first_available_table(spark, [None, "nope_a", "nope_b"])
    spark.createDataFrame([], "x long").createOrReplaceTempView("empty_features")
    with pytest.raises(ValueError):
        catalog.load_features(spark, ["empty_features"])
    spark.range(3).createOrReplaceTempView("some_features")
    df, name = catalog.load_features(spark, [None, "nope", "some_features"])
    assert name == "some_features" and df.count() == 3


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "days_since_signup", "orders_30d", "revenue_30d", "frequency_30d",
                          "pct_email", "pct_direct", "pct_organic", "pct_ads", "pct_social", "will_convert_14d"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_sizing(spark):
    from kpiloom.session import input_bytes, sizing_conf
    n = input_bytes(spark, [f"{SF_SMALL}/lineitem.parquet", f"{SF_SMALL}/orders.parquet"])
    assert n > 0
    assert sizing_conf(n)["spark.sql.shuffle.partitions"] == "200"            # floor for small inputs
    assert sizing_conf(100 << 40)["spark.sql.shuffle.partitions"] == "100000"  # 100 TB: the cap
    assert sizing_conf(1 << 40)["spark.sql.shuffle.partitions"] == "8192"      # 1 TB / 128 MB
    from kpiloom.session import size_session
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = size_session(spark, [f"{SF_SMALL}/lineitem.parquet"])
        assert spark.conf.get("spark.sql.shuffle.partitions") == conf["spark.sql.shuffle.partitions"] == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_publish_makes_a_named_view(spark):
    df = reports.run_report(spark, "ab_metrics", SF_SMALL)
    reports.publish(df, "ab_metrics_view_test")
    assert spark.catalog.tableExists("ab_metrics_view_test")
    assert spark.table("ab_metrics_view_test").count() == 2
    name = catalog.first_available_table(spark, [None, "ab_metrics_view_test"])
    assert name == "ab_metrics_view_test"


def test_reports_over_given_tables(spark):
    from kpiloom.sources.silver import Sources as S
    d = S(spark, SF_SMALL)
    # real-shaped tables: events without the adapter's raw type column
    src = S.from_tables(spark, d.users, d.orders, d.items, d.events.drop("raw_event_type"))
    for name in ("revenue_daily", "funnel_users", "retention_weekly", "features_conversion", "ab_experiment"):
        a = sorted(map(tuple, reports.run_report(spark, name, src).collect()))
        b = sorted(map(tuple, reports.run_report(spark, name, SF_SMALL).collect()))
        assert a == b, name
    d.users.createOrReplaceTempView("users_tbl")
    src2 = S.from_tables(spark, "users_tbl", d.orders, d.items, d.events)
    assert reports.run_report(spark, "ab_group", src2).count() == d.users.count()
    with pytest.raises(ValueError, match="order_items"):
        S.from_tables(spark, d.users, d.orders, d.items.drop("sale_price"), d.events)


def test_typed_parameter_list(spark):
    params = [{"name": "start", "type": "DATE", "value": "2024-01-05"},
              {"name": "end", "type": "DATE", "value": "2024-01-06"},
              {"name": "ignored", "type": "INT64", "value": "3"}]
    days = [r["day"] for r in reports.run_report(spark, "revenue_daily_range", SF_SMALL, params).collect()]
    assert days == [dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    open_end = [{"name": "start", "type": "DATE", "value": "2024-02-20"}, {"name": "end", "type": "DATE", "value": None}]
    assert all(r["day"] >= dt.date(2024, 2, 20)
               for r in reports.run_report(spark, "revenue_daily_range", SF_SMALL, open_end).collect())
    with pytest.raises(ValueError):
        reports.typed_params([{"name": "x", "type": "GEOGRAPHY", "value": "POINT(0 0)"}])


def test_instants_become_utc_wall_clock(spark):
    from kpiloom.sources.silver import conform
    from kpiloom.sources import schemas
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT 1L AS id, to_timestamp('2024-01-01 05:30:00+00:00') AS created_at")
        row = conform(df, schemas.USERS, "users").first()
        assert row["created_at"] == dt.datetime(2024, 1, 1, 5, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_command_line(spark, tmp_path, capsys):
    from kpiloom.__main__ import main
    assert main(["list"]) == 0
    assert "features_conversion" in capsys.readouterr().out
    out = str(tmp_path / "rd")
    assert main(["report", "revenue_daily_range", "--data", SF_SMALL, "--out", out,
                 "--param", "start=DATE:2024-01-05", "--param", "end=DATE:2024-01-06"]) == 0
    assert spark.read.parquet(out).count() == 2
