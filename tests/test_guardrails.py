import math
import random

import numpy as np
import pytest

from kpiloom.operators import guardrails
from kpiloom.operators.assignment import ab_group

from . import helpers as h


def plain(rows, groups, margin):
    """Delta-method test of {metric: {user: (x, y)}} by numpy, with Holm's steps by hand."""
    out = {}
    for metric, of in rows.items():
        ratio, var, n = {}, {}, {}
        for g in "AB":
            xy = np.array([v for u, v in of.items() if groups[u] == g])
            n[g] = len(xy)
            r = xy[:, 0].sum() / xy[:, 1].sum()
            c = np.cov(xy.T)
            ratio[g], var[g] = r, (c[0, 0] - 2 * r * c[0, 1] + r * r * c[1, 1]) / (len(xy) * xy[:, 1].mean() ** 2)
        z = (ratio["B"] - (1 - margin) * ratio["A"]) / math.sqrt(var["B"] + (1 - margin) ** 2 * var["A"])
        out[metric] = [n["A"], n["B"], ratio["A"], ratio["B"], z, 0.5 * math.erfc(z / math.sqrt(2))]
    worst = 0.0
    for i, (m, v) in enumerate(sorted(out.items(), key=lambda kv: kv[1][-1])):
        worst = max(worst, v[-1] * (len(out) - i))
        v.append(min(worst, 1.0))
    return out


def test_equals_numpy(spark):
    rng = random.Random(1)
    ids = list(range(1, 301))
    users = h.users(spark, [(i, "2024-01-01") for i in ids] + [(5, "2024-01-02"), (None, None)])
    groups = {r.user_id: r.ab_group for r in ab_group(users).collect() if r.user_id}
    orders, items, n = [], [], 0
    per = {m: {i: [0.0, 1.0] for i in ids} for m in ("events_per_user", "orders_per_user")}
    per["revenue_per_order"] = {i: [0.0, 0.0] for i in ids}
    for i in ids:
        for _ in range(rng.randint(0, 4)):
            n += 1
            status = rng.choice(["Complete", "Complete", "Shipped"])
            orders.append((n, i, status, "2024-01-05"))
            prices = [round(rng.uniform(1, 80), 2) for _ in range(rng.randint(0, 3))]
            items += [(n, p) for p in prices]
            if status == "Complete":
                per["orders_per_user"][i][0] += 1
                per["revenue_per_order"][i][0] += sum(prices)
                per["revenue_per_order"][i][1] += 1
    events = []
    for i in ids:
        k = rng.randint(0, 9)
        per["events_per_user"][i][0] = k
        events += [(i, "page_view", "2024-01-03", "Ads")] * k
    events += [(None, "page_view", "2024-01-03", "Ads"), (999, "page_view", "2024-01-03", "Ads")]
    ratios = guardrails.user_ratios(users, h.events(spark, events), h.orders(spark, orders + [(9999, None, "Complete", None)]),
                                    h.items(spark, items + [(None, 5.0)]))
    assert ratios.count() == 900
    want = plain(per, groups, 0.05)
    for r in guardrails.guardrail_test(ratios).collect():
        w = want[r.metric]
        assert [r.a_users, r.b_users] == w[:2]
        assert [r.a_ratio, r.b_ratio, r.z, r.p_value, r.p_holm] == pytest.approx(w[2:], rel=1e-9)
        assert r.safe == (w[-1] < 0.05)


def test_harm_is_not_safe_and_degenerate_metrics_are_null(spark):
    rng = np.random.default_rng(2)
    groups = {r.user_id: r.ab_group for r in ab_group(h.users(spark, [(i, None) for i in range(1, 801)])).collect()}
    rows = [(i, "same", float(rng.normal(10, 1)), 1.0) for i in groups]
    rows += [(i, "harmed", float(rng.normal(10 if g == "A" else 9, 1)), 1.0) for i, g in groups.items()]
    rows += [(i, "constant", 3.0, 1.0) for i in groups] + [(i, "nothing", 0.0, 0.0) for i in groups]
    rows += [(next(i for i, g in groups.items() if g == "A"), "one user", 1.0, 1.0)]
    got = {r.metric: r for r in guardrails.guardrail_test(
        spark.createDataFrame(rows, "user_id long, metric string, x double, y double")).collect()}
    assert got["same"].safe and not got["harmed"].safe
    assert got["harmed"].p_value > 0.99
    for m in ("constant", "nothing", "one user"):
        assert got[m].z is None and got[m].p_holm is None and got[m].safe is None
    assert got["same"].p_holm == pytest.approx(2 * got["same"].p_value)         # two metrics were tested
