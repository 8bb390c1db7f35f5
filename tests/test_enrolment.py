import datetime as dt
import hashlib
import random

import pytest

from kpiloom.operators import enrolment

from . import helpers as h

SCHEMA = "experiment string, starts timestamp_ntz, ends timestamp_ntz, share_a int, salt string"


def group(salt, i, share):
    return "A" if int(hashlib.md5(f"{salt}:{i}".encode()).hexdigest()[:8], 16) % 100 < share else "B"


@pytest.mark.parametrize("hot", [None, 5])
def test_equals_a_loop_over_users_and_experiments(spark, hot):
    rng = random.Random(1)
    at = lambda lo, hi: f"2024-01-{rng.randint(lo, hi):02d} {rng.randint(0, 23):02d}:00:00"
    users = [(i, "2024-01-01") for i in range(1, 60)] + [(3, "2024-01-02"), (None, None)]
    events = [(rng.randint(1, 65), "page_view", at(1, 20), "Ads") for _ in range(200)] + [(None, "x", "2024-01-02", "Ads")]
    orders = [(n, rng.choice([7, rng.randint(1, 60)]), rng.choice(["Complete", "Shipped"]), at(1, 28)) for n in range(150)]
    orders += [(900, None, "Complete", "2024-01-09"), (901, 4, "Complete", None)]
    ts = h.ts
    plans = [("one", ts("2024-01-01"), ts("2024-01-10 12:00:00"), 50, "s1"), ("two", ts("2024-01-03 06:00:00"), ts("2024-01-25"), 20, None),
             ("empty", ts("2024-01-05"), ts("2024-01-05"), 50, "s"), ("open", None, ts("2024-01-05"), 50, "s"),
             ("short", ts("2024-01-04 09:00:00"), ts("2024-01-04 12:00:00"), 50, "s4"), ("never", ts("2025-01-01"), ts("2025-02-01"), 50, "s")]
    frames = (h.users(spark, users), h.events(spark, events), h.orders(spark, orders), spark.createDataFrame(plans, SCHEMA))
    first = {}
    for u, _, t, _ in events:
        if u is not None and any(u == i for i, _ in users):
            first[u] = min(first.get(u, ts(t)), ts(t))
    want, placed = {}, set()
    for name, starts, ends, share, salt in plans:
        for u, t in first.items():
            if starts and starts <= t < ends:
                g = group(salt or name, u, share)
                placed.add((name, u, g))
                cell = want.setdefault(name, {"A": [0, 0], "B": [0, 0]})[g]
                cell[1] += 1
                cell[0] += any(o[1] == u and o[2] == "Complete" and o[3] and t <= ts(o[3]) < ends for o in orders)
    got = enrolment.enrolled(*frames[:2], frames[3])
    assert {(r.experiment, r.user_id, r.ab_group) for r in got.collect()} == placed
    if hot:
        spark.conf.set("spark.kpiloom.hotKeyRows", str(hot))
    try:
        rows = enrolment.experiment_board(*frames).collect()
    finally:
        spark.conf.unset("spark.kpiloom.hotKeyRows")
    assert {r.experiment for r in rows} == set(want)
    for r in rows:
        for g in "AB":
            assert [r[f"{g.lower()}_success"] or 0, r[f"{g.lower()}_total"] or 0] == want[r.experiment][g]


def test_events_are_read_once_for_all_experiments(spark):
    n = 400
    plans = spark.createDataFrame([(f"e{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), dt.datetime(2024, 2, 1), 50, f"s{i}")
                                   for i in range(n)], SCHEMA)
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "user_id", "event_type", "ts as created_at", "'Ads' as traffic_source")
    users = src.selectExpr("user_id as id", "cast(null as timestamp_ntz) as created_at").distinct()
    plan = enrolment.enrolled(users, src, plans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
