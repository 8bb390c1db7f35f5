import itertools
import math

import numpy as np
import pytest

from kpiloom.ml import evaluate
from kpiloom.ml.linear import LinearScorer
from kpiloom.sources import artifacts


def test_scores_are_squashed_margins(spark, tmp_path):
    rows = [(1, 2.0, -1.0, 1), (2, 0.0, 0.0, 0), (3, -40.0, 3.0, 0)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, y int")
    model = LinearScorer(0.5, {"b": 2.0, "a": -1.0})
    got = {r.user_id: r.score for r in evaluate.score(model, df, "y").collect()}
    for i, a, b, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(0.5 + 2 * b - a))))
    artifacts.save_run(spark, model, ["b", "a"], spark.createDataFrame([("m",)], "model string"), str(tmp_path))
    again = artifacts.load_model(spark, str(tmp_path))
    assert (again.intercept, list(again.weights.items())) == (0.5, [("b", 2.0), ("a", -1.0)])


def test_importance_equals_brute_force_shapley(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3)) * [1, 5, 0.1]
    w = {"a": 1.0, "b": -0.5, "c": 7.0}
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    mean, weights = x.mean(axis=0), np.array(list(w.values()))

    def value(row, known):
        return sum(weights[j] * (row[j] if j in known else mean[j]) for j in range(3))

    phi = np.zeros((20, 3))
    for i, row in enumerate(x):
        for order in itertools.permutations(range(3)):
            for k, j in enumerate(order):
                phi[i, j] += (value(row, order[:k + 1]) - value(row, order[:k])) / 6
    want = dict(zip(w, np.abs(phi).mean(axis=0)))
    got = LinearScorer(3.0, w).importance(df).collect()
    assert {r.feature: r.mean_abs_shap for r in got} == pytest.approx(want)
    assert [r.feature for r in got] == sorted(want, key=want.get, reverse=True)
