"""Sequential looks, power and exposure."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.functions.stats import norm_ppf
from kpiloom.operators import exposure, power, sequential
from kpiloom.operators.asof import latest_state

from . import helpers as h

N = NormalDist()
CELLS = "a_success long, a_total long, b_success long, b_total long"


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.074, 0.0751, 0.3, 0.5, 0.62, 0.925, 0.9251, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps + [0.0, 1.0, -1.0]], "p double")
    got = {r.p: r.z for r in df.select("p", norm_ppf("p").alias("z")).collect()}
    for p in ps:
        assert got[p] == pytest.approx(N.inv_cdf(p), rel=1e-12, abs=1e-15)
    assert got[0.0] is None and got[1.0] is None and got[-1.0] is None


# -- sequential ---------------------------------------------------------------

def days(rng, n_days, per_day, rate_a, rate_b):
    return [(d, int(rng.binomial(per_day, rate_a)), per_day, int(rng.binomial(per_day, rate_b)), per_day)
            for d in range(n_days)]


def plain_looks(rows, alpha=0.05, s=sequential.EFFECT_SD, first=sequential.FIRST_LOOK):
    out, total, p, stop = [], [0] * 4, 1.0, False
    for row in rows:
        total = [t + (x or 0) for t, x in zip(total, row[1:])]
        a_s, a_n, b_s, b_n = total
        z = bound = None
        pooled = (a_s + b_s) / (a_n + b_n) if a_n + b_n else 0
        if a_n >= first and b_n >= first and 0 < pooled < 1:
            v = pooled * (1 - pooled) * (1 / a_n + 1 / b_n)
            d = b_s / b_n - a_s / a_n
            z = d / math.sqrt(v)
            ratio = math.sqrt(v / (v + s * s)) * math.exp(d * d * s * s / (2 * v * (v + s * s)))
            p = min(p, 1 / ratio)
            stop = stop or ratio >= 1 / alpha
            bound = math.sqrt(2 * (v + s * s) / (s * s) * (math.log(1 / alpha) + math.log((v + s * s) / v) / 2))
        out.append((row[0], *total, z, bound, p, stop))
    return out


def test_looks_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = days(rng, 40, 25, 0.2, 0.24) + [(40, None, None, 3, 20), (41, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, f"day int, {CELLS}").repartition(3)
    got = sequential.sequential_test(df, "day").orderBy("day").collect()
    for r, want in zip(got, plain_looks(rows)):
        day, *total, z, bound, p, stop = want
        assert [r.day, r.a_success, r.a_total, r.b_success, r.b_total] == [day, *total]
        assert r.z == pytest.approx(z, rel=1e-9) if z is not None else r.z is None
        assert r.bound == pytest.approx(bound, rel=1e-9) if bound is not None else r.bound is None
        assert r.p_always == pytest.approx(p, rel=1e-9)
        assert (r.stop, r.valid) == (stop, z is not None)


def test_false_alarms_over_sixty_looks(spark):
    """Without an effect at most alpha of the experiments ever stop; with one nearly all do."""
    rng = np.random.default_rng(7)
    rows = [(k, "null", *r) for k in range(1500) for r in days(rng, 60, 50, 0.1, 0.1)]
    rows += [(k, "effect", *r) for k in range(100) for r in days(rng, 60, 200, 0.1, 0.15)]
    df = spark.createDataFrame(rows, f"k int, kind string, day int, {CELLS}")
    out = sequential.sequential_test(df, "day", keys=["kind", "k"])
    stopped = {r.kind: r.s for r in out.where("day = 59").groupBy("kind").agg(
        F.avg(F.col("stop").cast("double")).alias("s")).collect()}
    assert stopped["null"] <= 0.05
    assert stopped["effect"] > 0.95
    naive = out.where(F.abs("z") > 1.96).select("kind", "k").distinct().where("kind = 'null'").count() / 1500
    assert naive > 0.15                         # what reading the plain test every day would do


# -- power --------------------------------------------------------------------

def plain_power(rate, effect, na, nb, alpha=0.05):
    other = rate + effect
    pooled = (rate * na + other * nb) / (na + nb)
    se0 = math.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb))
    se1 = math.sqrt(rate * (1 - rate) / na + other * (1 - other) / nb)
    z = N.inv_cdf(1 - alpha / 2)
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    return phi((effect - z * se0) / se1) + phi((-effect - z * se0) / se1)


def test_power_equals_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        na, nb = rng.randint(20, 5000), rng.randint(20, 5000)
        rows.append((rng.randint(1, na - 1), na, rng.randint(0, nb), nb))
    rows += [(0, 10, 1, 10), (10, 10, 1, 10), (1, 0, 1, 10), (5, 10, 5, 0), (None, 10, 1, 10), (3, 4, 1, 4)]
    df = spark.createDataFrame(rows, CELLS)
    for r in power.power_analysis(df).collect():
        usable = r.a_total and r.b_total and r.a_success and 0 < r.a_success < r.a_total
        assert r.valid == bool(usable)
        if not usable:
            assert r.power is None and r.min_effect is None and r.users_needed is None
            continue
        rate, uplift = r.a_success / r.a_total, r.b_success / r.b_total - r.a_success / r.a_total
        assert r.power == pytest.approx(plain_power(rate, uplift, r.a_total, r.b_total), abs=1e-9)
        if r.min_effect is None:
            assert plain_power(rate, 1 - rate, r.a_total, r.b_total) < 0.8
        else:
            assert plain_power(rate, r.min_effect, r.a_total, r.b_total) == pytest.approx(0.8, abs=1e-6)
        if uplift:
            assert r.users_needed >= 1


def test_users_needed_reach_the_power(spark):
    df = spark.createDataFrame([(100, 1000, 130, 1000)], CELLS)
    r = power.power_analysis(df).first()
    n = r.users_needed
    assert plain_power(0.1, 0.03, n, n) >= 0.79 and plain_power(0.1, 0.03, 0.9 * n, 0.9 * n) < 0.79


# -- as-of and exposure -------------------------------------------------------

def test_latest_state_equals_a_search(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(50)]), i) for i in range(400)]
    states = [(rng.choice([1, 2, 4, None]), rng.choice([None, *range(50)]), rng.randint(0, 99)) for _ in range(30)]
    df = spark.createDataFrame(rows, "k int, t int, i int").repartition(3)
    st = spark.createDataFrame(states, "k int, t int, s int")
    for limit in (1000, 20):                    # with 20, the hot key is split
        got = {r.i: r.s for r in latest_state(df, st, "k", "t", "s", limit).collect()}
        assert len(got) == 400
        for k, t, i in rows:
            seen = [(st_t, s) for st_k, st_t, s in states
                    if k is not None and t is not None and st_k == k and st_t is not None and st_t <= t]
            assert got[i] == (max(seen)[1] if seen else None)


def test_only_conversions_after_exposure_count(spark):
    users = h.users(spark, [(i, "2024-01-05") for i in range(1, 9)] + [(8, "2024-02-01"), (None, "2024-01-01")])
    events = h.events(spark, [
        (1, "page_view", "2024-01-06", "Ads"), (2, "page_view", "2024-01-01", "Ads"), (2, "page_view", "2024-01-09", "Ads"),
        (3, "page_view", "2024-01-02", "Ads"), (4, "add_to_cart", "2024-01-09", "Ads"), (5, "page_view", "2024-01-05", "Ads"),
        (8, "page_view", "2024-01-20", "Ads"), (99, "page_view", "2024-01-09", "Ads"), (None, "page_view", "2024-01-09", "Ads")]
        + [(7, "page_view", f"2024-01-{d:02d}", "Ads") for d in range(1, 29)])
    orders = h.orders(spark, [
        (1, 1, "Complete", "2024-01-06"), (2, 2, "Complete", "2024-01-08"), (3, 3, "Complete", "2024-01-20"),
        (4, 4, "Complete", "2024-01-20"), (5, 5, "Returned", "2024-01-20"), (6, 7, "Complete", "2024-01-03"),
        (7, 7, "Complete", "2024-01-30"), (8, None, "Complete", "2024-01-30"), (9, 8, "Complete", None)])
    for limit in (None, 5):
        at = {r.user_id: r.exposed_at.day for r in exposure.exposures(users, events, limit=limit).collect()}
        assert at == {1: 6, 2: 9, 5: 5, 7: 5, 8: 20}
        got = {r.ab_group: r for r in exposure.exposure_metrics(users, events, orders, limit=limit).collect()}
        total = {c: sum(r[c] for r in got.values()) for c in ("assigned", "exposed", "converters", "early_converters")}
        assert total == {"assigned": 8, "exposed": 5, "converters": 2, "early_converters": 4}
        for r in got.values():
            assert r.exposure_rate == r.exposed / r.assigned
