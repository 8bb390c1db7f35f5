import itertools
import random
import re

import pytest

from kpiloom.operators import features, quality as dq, retention, revenue
from kpiloom.plans.incremental import IncrementalGold

from . import helpers as h


def data(seed):
    rng = random.Random(seed)
    orders = [(i, rng.choice([1, 2, 3, None]), rng.choice(["Complete", "Complete", "Shipped"]),
               rng.choice([f"2024-01-{rng.randint(1, 12):02d} 10:00:00", None])) for i in range(60)]
    orders += [(100, 1, "Complete", "2024-01-03"), (100, 1, "Shipped", "2024-01-03")]
    items = [(rng.choice([*range(70), 100, None]), rng.choice([None, 1.25, 10.0, 0.12345, float(rng.randint(1, 99))]))
             for _ in range(200)]
    events = [(rng.choice([1, 2, 3, None]), "page_view", f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00",
               "Ads") for _ in range(150)]
    return orders, items, events


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y, strict=True):
            assert u == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_equals_a_rebuild(spark, tmp_path, seed):
    orders, items, events = data(seed)
    users = h.users(spark, [(1, "2023-12-20"), (2, "2024-01-04"), (3, "2024-01-04"), (4, "2024-01-09")])
    all_orders, all_items, all_events = h.orders(spark, orders), h.items(spark, items), h.events(spark, events)
    want = [rows(revenue.revenue_daily(all_orders, all_items)), rows(features.last_event(all_events)),
            rows(retention.retention_weekly(users, all_events))]
    batches = {
        "a": dict(orders=h.orders(spark, [o for o in orders if o[0] % 2]), items=h.items(spark, items[:60])),
        "b": dict(items=h.items(spark, items[60:120]), events=h.events(spark, events[:70])),
        "c": dict(orders=h.orders(spark, [o for o in orders if not o[0] % 2]), items=h.items(spark, items[120:]),
                  events=h.events(spark, events[70:])),
    }
    order = list(itertools.permutations("abc"))[seed * 2]
    gold = IncrementalGold(spark, str(tmp_path / "gold"))
    for name in (*order, order[0]):
        gold.apply(name, **batches[name])
    near(rows(gold.revenue_daily()), want[0])
    assert rows(gold.last_event()) == want[1]
    assert rows(gold.retention_weekly(users)) == want[2]
    assert gold.apply(order[1], **batches[order[1]]) == []          # a repeated batch does nothing
    near(rows(gold.revenue_daily()), want[0])


def test_only_touched_days_are_read_and_written(spark, tmp_path):
    gold = IncrementalGold(spark, str(tmp_path / "gold"))
    day = "2024-01-{:02d}".format
    gold.apply("all", orders=h.orders(spark, [(i, 1, "Complete", day(i)) for i in range(1, 21)]),
               items=h.items(spark, [(i, 2.0) for i in range(1, 21)]))
    before = {f: f for f in gold.gold("revenue_daily").inputFiles()}
    touched = gold.apply("late", items=h.items(spark, [(5, 1.0), (5, 1.5), (77, 9.0)]))
    assert touched == [day(5)]
    after = set(gold.gold("revenue_daily").inputFiles())
    assert len(after & set(before)) == 19 and len(after) == 20       # one day's file is new
    assert all(f"part={day(5)}" in f for f in after - set(before))
    read = gold.state("items", [day(5)])
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ (=|IN)", read._jdf.queryExecution().executedPlan().toString())
    assert {r.part for r in read.collect()} == {day(5)}
    assert {r.day.day: (r.orders, r.revenue) for r in gold.revenue_daily().collect()}[5] == (3, 4.5)
    # the order that the waiting item belongs to
    assert gold.apply("order-77", orders=h.orders(spark, [(77, 1, "Complete", day(9))])) == [day(9)]
    assert {r.day.day: r.revenue for r in gold.revenue_daily().collect()}[9] == 11.0


def test_late_rows_and_interrupted_batches(spark, tmp_path, monkeypatch):
    gold = IncrementalGold(spark, str(tmp_path / "gold"))
    ev = lambda d, n: h.events(spark, [(1, "page_view", f"2024-01-{d:02d}", "Ads")] * n)
    gold.apply("one", events=ev(10, 3))
    batch = ev(4, 2).union(ev(11, 1))
    with monkeypatch.context() as m:
        m.setattr(gold, "_activity_daily", lambda parts: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            gold.apply("two", events=batch)
    assert gold.apply("two", events=batch) == ["2024-01-04", "2024-01-11"]
    assert sorted((r.batch, r.rows, r.late_rows, r.newest) for r in gold.ledger().collect()) == [
        ("one", 3, 0, "2024-01-10"), ("two", 3, 2, "2024-01-11")]
    assert rows(gold.activity_daily().selectExpr("day(day)", "events", "active_users")) == [(10, 3, 1), (11, 1, 1), (4, 2, 1)]
    gold.apply("none", events=ev(1, 1).limit(0))
    assert gold.activity_daily().count() == 3


def test_orders_and_events_are_filed_at_the_same_time(spark, tmp_path, monkeypatch):
    import threading
    gold, both = IncrementalGold(spark, str(tmp_path / "gold")), threading.Barrier(2, timeout=60)
    file = gold._file

    def meeting(df, name, batch):
        if name in ("orders", "activity"):
            both.wait()
        return file(df, name, batch)
    monkeypatch.setattr(gold, "_file", meeting)
    gold.apply("a", orders=h.orders(spark, [(1, 1, "Complete", "2024-01-02")]), items=h.items(spark, [(1, 2.5)]),
               events=h.events(spark, [(1, "page_view", "2024-01-03", "Ads")]))
    assert [r.revenue for r in gold.revenue_daily().collect()] == [2.5] and gold.activity_daily().count() == 1
    assert gold.ledger().count() == 3


def test_relationships_count_rows_and_keys(spark):
    users = h.users(spark, [(1, "2024-01-01"), (2, "2024-01-01"), (None, None)])
    orders = h.orders(spark, [(1, 1, "Complete", None), (2, 7, "Complete", None), (3, None, "Complete", None)]
                      + [(i, 9, "Complete", None) for i in range(4, 50)])
    items = h.items(spark, [(1, 1.0), (3, 1.0), (None, 1.0)])
    events = h.events(spark, [(5, "page_view", "2024-01-01", "Ads")])
    tables = {"users": users, "orders": orders, "order_items": items, "events": events}
    got = {(r.model, r.column): (r.failures, r.orphan_keys, r.passed) for r in dq.run_relationships(tables).collect()}
    assert got == {("orders", "user_id"): (47, 2, False), ("order_items", "order_id"): (0, 0, True),
                   ("events", "user_id"): (1, 1, False)}
    with pytest.raises(KeyError):
        dq.run_relationships({"orders": orders})
    with pytest.raises(dq.QualityGateError):
        dq.gate(dq.run_relationships(tables))


def test_orphans_stop_the_batch_before_any_model(spark, tmp_path):
    from kpiloom.plans.daily import run_daily_batch
    from kpiloom.sources.silver import Sources
    src = Sources.from_tables(
        spark, h.users(spark, [(1, "2024-01-01")]), h.orders(spark, [(1, 1, "Complete", "2024-01-02")]),
        h.items(spark, [(1, 1.0), (2, 1.0)]), h.events(spark, [(1, "page_view", "2024-01-02", "Ads")]))
    with pytest.raises(dq.QualityGateError, match="order_items.order_id relationship .1 failures"):
        run_daily_batch(spark, src, str(tmp_path / "out"), relationships=True)
    assert not (tmp_path / "out").exists()


def test_bounds_flag_planted_spikes(spark):
    import datetime as dt
    rng = random.Random(1)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    plain = [(day(i), 100 + rng.random() * 10, 5.0) for i in range(60) if i not in (20, 21)]
    plain[40] = (plain[40][0], 400.0, 5.0)
    plain[45] = (plain[45][0], None, 5.0)
    plain[50] = (plain[50][0], 100.0, 6.0)
    df = spark.createDataFrame(plain + [(None, 9e9, 9e9)], "day date, x double, flat double")
    got = dq.metric_bounds(df, "day", ["x", "flat"]).collect()
    assert len(got) == 2 * 58
    assert {(r.metric, r.day) for r in got if r.flagged} == {("x", plain[40][0]), ("flat", plain[50][0])}
    for r in got:
        past = [(v[1] if r.metric == "x" else v[2]) for v in plain if dt.timedelta(0) < r.day - v[0] <= dt.timedelta(28)]
        past = sorted(v for v in past if v is not None)
        assert r.n == len(past) and (r.median is None) == (len(past) < 7)
        if r.median is not None:
            import statistics
            assert r.median == pytest.approx(statistics.median(past))
            assert r.mad == pytest.approx(statistics.median(abs(v - r.median) for v in past))
