"""Edge rows of FIXTURES §4 on hand-built silver tables."""

import datetime as dt

import pytest

from kpiloom.operators import assignment as asg
from kpiloom.operators import features as feat
from kpiloom.operators import funnel as fun
from kpiloom.operators import retention as ret
from kpiloom.operators import revenue as rev

from .helpers import events, items, orders, users


def by_user(df):
    return {r["user_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def fx(spark):
    anchor = "2024-01-20 12:00:00"
    u = users(spark, [
        (1, "2024-01-01 00:00:00"),      # no orders
        (2, "2024-01-01 00:00:00"),      # only in-window order has no items
        (3, "2024-01-01 00:00:00"),      # boundary orders
        (4, "2024-01-01 00:00:00"),      # no events
        (5, "2024-01-19 23:00:00"),      # signup 23:00, anchor next day 01:00
        (6, "2024-01-01 00:00:00"),      # label at anchor + 14 d + 1 microsecond only
        (7, "2024-01-01 00:00:00"),      # label at anchor exactly only
    ])
    e = events(spark, [
        (1, "page_view", anchor, "Email"), (1, "add_to_cart", "2024-01-10 00:00:00", "Direct"),
        (2, "view", anchor, "Other"),
        (3, "page_view", anchor, "Email"), (3, None, "2024-01-02 00:00:00", "Email"),
        (5, "page_view", "2024-01-20 01:00:00", "Social"),
        (6, "page_view", anchor, "Ads"), (7, "page_view", anchor, "Ads"),
        (None, "page_view", "2024-01-05 00:00:00", "Email"),
    ])
    o = orders(spark, [
        (20, 2, "Complete", "2024-01-15 00:00:00"),                 # in window, no items
        (30, 3, "Complete", "2023-12-21 12:00:00"),                 # anchor - 30 d exactly: counted
        (31, 3, "Returned", "2023-12-21 11:59:59"),                 # just before: not counted
        (32, 3, "Processing", "2024-02-03 12:00:00"),               # anchor + 14 d exactly: label 1, after anchor
        (60, 6, "Complete", "2024-02-03 12:00:00.000001"),         # anchor + 14 d + 1 us: label 0
        (70, 7, "Complete", anchor),                                # anchor exactly: label 0
    ])
    i = items(spark, [(30, 10.0), (30, 5.5), (31, 99.0), (32, 1.25), (60, 3.0), (70, 4.0)])
    return u, e, o, i


def test_features_edges(fx):
    u, e, o, i = fx
    f = by_user(feat.features_conversion(u, o, i, e))
    assert 4 not in f and None not in f                            # users without events are dropped
    assert (f[1]["orders_30d"], f[1]["revenue_30d"], f[1]["frequency_30d"], f[1]["will_convert_14d"]) == (0, 0.0, 0, 0)
    assert f[2]["orders_30d"] == 1 and f[2]["revenue_30d"] is None and f[2]["frequency_30d"] == 1
    # 30 (2 item rows) + 32 (after the anchor, 1 item row); 31 is 1 s too early
    assert (f[3]["orders_30d"], f[3]["revenue_30d"], f[3]["frequency_30d"]) == (3, 16.75, 2)
    assert f[3]["will_convert_14d"] == 1
    assert f[5]["days_since_signup"] == 0
    assert f[6]["will_convert_14d"] == 0 and f[7]["will_convert_14d"] == 0
    assert f[1]["pct_email"] == 0.5 and f[1]["pct_direct"] == 0.5
    assert f[2]["pct_email"] == 0.0                                # only 'Other': shares sum to 0
    assert f[3]["pct_email"] == 1.0


def test_features_parts_agree(fx):
    u, e, o, i = fx
    whole = by_user(feat.features_conversion(u, o, i, e))
    anchors = feat.last_event(e)
    parts = by_user(feat.rfm(u, o, i, anchors))
    label = by_user(feat.conversion_label(anchors, o))
    assert None in label and label[None]["will_convert_14d"] == 0  # null user keeps a label row
    for k, r in whole.items():
        for c in ("days_since_signup", "orders_30d", "revenue_30d", "frequency_30d"):
            assert r[c] == parts[k][c]
        assert r["will_convert_14d"] == label[k]["will_convert_14d"]


def test_funnel_edges(spark, fx):
    u, e, o, i = fx
    f = by_user(fun.funnel_users(u, e, o))
    assert set(f) == {1, 2, 3, 4, 5, 6, 7}
    assert f[4]["visited"] is False and f[4]["added_to_cart"] is False and f[4]["converted"] is False
    assert f[1]["visited"] and f[1]["added_to_cart"] and not f[1]["converted"]
    assert f[2]["converted"] and not f[2]["visited"]
    first = by_user(fun.funnel_event_set(e, o, steps={"saw_landing": "page_view", "saw_product": "view",
                                                      "saw_cart": "add_to_cart"}))
    assert None in first and first[None]["saw_landing"] and not first[None]["converted"]
    assert 4 not in first
    assert first[3]["saw_landing"] and not first[3]["saw_cart"]   # the null type is ignored
    sets = by_user(fun.event_type_sets(e))
    assert sets[3]["events"] == ["page_view"]


def test_revenue_zero_days(spark):
    o = orders(spark, [(1, 1, "Complete", "2024-01-01 10:00:00"), (2, 1, "Returned", "2024-01-02 10:00:00"),
                       (3, 1, "Complete", "2024-01-01 11:00:00"), (4, 1, "Complete", "2024-01-03 00:00:00")])
    i = items(spark, [(1, 10.0), (1, 20.0), (2, 7.0), (3, 30.0)])
    gold = {r["day"]: r for r in rev.revenue_daily(o, i).collect()}
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert (gold[d1]["orders"], gold[d1]["revenue"], gold[d1]["aov"]) == (3, 60.0, 20.0)   # item rows
    assert (gold[d2]["orders"], gold[d2]["revenue"], gold[d2]["aov"]) == (0, 0.0, None)
    assert dt.date(2024, 1, 3) not in gold                                                # no items
    first = {r["day"]: r for r in rev.revenue_daily_completed(o, i).collect()}
    assert set(first) == {dt.datetime(2024, 1, 1)}
    r = first[dt.datetime(2024, 1, 1)]
    assert (r["orders"], r["revenue"], r["aov"]) == (2, 60.0, 20.0)                       # distinct orders


def test_retention_weeks(spark):
    u = users(spark, [(1, "2024-01-07 12:00:00"),   # a Sunday
                      (2, "2024-01-08 12:00:00")])  # the Monday after
    e = events(spark, [
        (1, "x", "2024-01-08 00:00:00", "Email"),   # Monday
        (2, "x", "2024-01-05 00:00:00", "Email"),   # before signup
        (2, "x", "2024-04-08 00:00:00", "Email"),   # 13 weeks later
        (2, "x", "2024-01-09 00:00:00", "Email"),
        (None, "x", "2024-01-09 00:00:00", "Email"),
    ])
    gold = {(r["cohort_week"], r["week_n"]): r["retention_rate"] for r in ret.retention_weekly(u, e).collect()}
    # Monday weeks: 2024-01-07 belongs to the week of 2024-01-01
    assert gold == {(dt.date(2024, 1, 1), 1): 1.0, (dt.date(2024, 1, 8), 0): 1.0}
    first = {(r["cohort_week"], r["week_number"]): r["retention"] for r in ret.retention_unbounded(u, e).collect()}
    # Sunday weeks: both users sign up in the week of 2024-01-07; negative and 13-week offsets are kept
    assert first[(dt.date(2024, 1, 7), 0)] == 1.0
    assert first[(dt.date(2024, 1, 7), -1)] == 0.5
    assert first[(dt.date(2024, 1, 7), 13)] == 0.5


def test_null_id_goes_to_b(spark):
    u = spark.createDataFrame([(None, None), (1, None)], "id long, created_at timestamp_ntz")
    g = {r["user_id"]: r["ab_group"] for r in asg.ab_group(u).collect()}
    assert g[None] == "B"
