"""The daily batch end to end with a light training profile."""

import math
import random

import pytest

from kpiloom.ml import train
from kpiloom.operators import experiments as exp
from kpiloom.plans.daily import champion_scores, run_daily_batch
from kpiloom.sources import artifacts


def test_daily_batch_end_to_end(spark, tmp_path):
    out = str(tmp_path / "run")
    prof = train.Profile(rf_trees=10, rf_max_depth=5, gbt_rounds=5, lr_max_iter=100)
    report, run = run_daily_batch(spark, "/root/testdata/sf0.01", out, profile=prof)
    assert report.filter("passed").count() == 11
    board = {r["model"]: r for r in run.leaderboard.collect()}
    assert set(board) == set(train.CANDIDATES)
    assert all(r["rows"] == 150 and r["target"] == "will_convert_14d" for r in board.values())
    best = max(board.values(), key=lambda r: (r["auc"], r["accuracy"], -r["train_order"]))
    assert run.champion == best["model"]
    metrics = artifacts.load_metrics(spark, out)
    assert metrics.filter("chosen").first()["model"] == run.champion
    assert artifacts.load_columns(spark, out) == run.features
    if run.champion in train.TREE_MODELS:
        imp = artifacts.load_importance(spark, out).collect()
        assert {r["feature"] for r in imp} == set(run.features)
    else:
        assert run.importance is None
    s = champion_scores(run)
    assert s.count() == run.test.count()


def reference_test(a_s, a_n, b_s, b_n):
    pa, pb = a_s / a_n, b_s / b_n
    u = pb - pa
    n = a_n + b_n
    e = n / 2
    chi2 = (a_n - e) ** 2 / e + (b_n - e) ** 2 / e
    pooled = (a_s + b_s) / n
    se = math.sqrt(pooled * (1 - pooled) * (1 / a_n + 1 / b_n))
    z = u / se
    return u, math.erfc(abs(z) / math.sqrt(2)), u - 1.96 * se, u + 1.96 * se, math.erfc(math.sqrt(chi2 / 2))


def test_ab_test_matches_plain_python(spark):
    rng = random.Random(5)
    cells = []
    for _ in range(300):
        a_n, b_n = rng.randint(1, 10 ** rng.randint(1, 7)), rng.randint(1, 10 ** rng.randint(1, 7))
        cells.append((rng.randint(0, a_n), a_n, rng.randint(0, b_n), b_n))
    df = spark.createDataFrame(cells, "a_success long, a_total long, b_success long, b_total long")
    for r in exp.ab_test(df).collect():
        key = (r["a_success"], r["a_total"], r["b_success"], r["b_total"])
        pooled = (key[0] + key[2]) / (key[1] + key[3])
        if pooled in (0.0, 1.0):
            assert r["valid"] is False
            continue
        u, p, lo, hi, srm = reference_test(*key)
        assert r["valid"]
        assert r["uplift"] == pytest.approx(u, abs=1e-15)
        assert r["ci_low"] == pytest.approx(lo, abs=1e-15) and r["ci_high"] == pytest.approx(hi, abs=1e-15)
        assert abs(r["p_value"] - p) < 1e-14 and abs(r["srm_p"] - srm) < 1e-14
