"""The forest whose trees lie in parts: against a plain search, MLlib, and itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.ml import evaluate, explain, forest, prepare, train
from kpiloom.ml.forest import Forest
from kpiloom.sources import artifacts

FEATURES = ["a", "b", "c", "d"]


def frame(spark, n, seed, parts=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.random(n), np.zeros(n)])
    x[rng.random(n) < 0.03, 2] = np.nan
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] + (x[:, 1] > 2) - np.nan_to_num(x[:, 2]) - 0.5)))
    y = rng.random(n) < p
    data = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "user_id long, a double, b double, c double, d double, y int").repartition(parts)


def scores(model, df):
    return {r.user_id: r.score for r in evaluate.score(model, df, "y").collect()}


def plain_part(bins, y, w, code, depth):
    """Every node by search over its rows; (share of its leaf) per row."""
    out = np.zeros(len(y))

    def gini(m):
        n, k = w[m].sum(), (w * y)[m].sum()
        return 2 * k * (n - k) / n if n else 0.0

    def grow(m, code, left):
        n, k = w[m].sum(), (w * y)[m].sum()
        best = (1e-9, None)
        if left and 0 < k < n:
            for f in forest.drawn_features(code, bins.shape[1])[0]:
                for b in range(int(bins.max())):
                    a, c = m & (bins[:, f] <= b), m & (bins[:, f] > b)
                    if w[a].sum() and w[c].sum() and gini(m) - gini(a) - gini(c) > best[0] + 1e-12:
                        best = (gini(m) - gini(a) - gini(c), (a, c))
        if best[1]:
            codes = forest.child_codes(code)[0]
            a, c = (grow(s, codes[i:i + 1], left - 1) for i, s in enumerate(best[1]))
            if not (a[0] and c[0] and a[1] == c[1]):
                return False, None
        out[m] = k / n
        return True, 2 * k > n

    grow(np.ones(len(y), bool), code, depth)
    return out


def test_a_part_equals_a_plain_search():
    rng = np.random.default_rng(3)
    for seed in range(4):
        bins = rng.integers(0, 6, (150, 4)).astype(np.uint8)
        y, w = (rng.random(150) < 0.4).astype(float), rng.integers(1, 4, 150).astype(float)
        code = forest.root_code(seed, 42)
        got = forest.grow_part(bins, y, w, code, 5, 6)
        k = got.of_bins(bins)
        assert np.allclose(got.ones[k] / got.rows[k], plain_part(bins, y, w, code, 5))


def test_bags_draw_with_replacement():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    w = forest.bag_weights(keys, 3, 42)
    assert abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.02 and abs(w.var() - 1) < 0.06
    assert (w != forest.bag_weights(keys, 4, 42)).mean() > 0.5


@pytest.mark.parametrize("part_rows", [60, 1 << 17])
def test_neither_partitioning_nor_parts_change_a_score(spark, monkeypatch, part_rows):
    how = Forest(trees=5, depth=6, bins=16)
    want = scores(forest.fit_forest(frame(spark, 500, 2, 1), FEATURES, "y", how=how), frame(spark, 500, 2))
    monkeypatch.setattr(forest, "PART_ROWS", part_rows)
    model = forest.fit_forest(frame(spark, 500, 2, 5), FEATURES, "y", how=how)
    assert (model.parts(spark).count() > 5) == (part_rows == 60)
    got = scores(model, frame(spark, 500, 2))
    assert got.keys() == want.keys() and len(got) == 500
    assert all(got[i] == pytest.approx(want[i], abs=1e-7) for i in got)


def test_scores_like_the_library(spark):
    rows, test = (frame(spark, n, s).na.fill(0.5).cache() for n, s in ((3000, 5), (1500, 6)))
    prof = train.Profile(rf_trees=30, rf_max_depth=8)
    theirs = evaluate.auc(evaluate.score(train.model_spec("random_forest", FEATURES, "y", 3000, prof).fit(rows), test, "y"))
    mine = evaluate.auc(evaluate.score(forest.fit_forest(rows, FEATURES, "y", how=Forest(30, 8)), test, "y"))
    assert mine == pytest.approx(theirs, abs=0.02) and mine > 0.7


def test_large_training_sets_leave_no_forest_on_the_driver(spark, monkeypatch, tmp_path):
    """Every MLlib node lives on the driver: above ``RF_LIBRARY_ROWS`` none is made."""
    monkeypatch.setattr(train, "RF_LIBRARY_ROWS", 300)
    rows, test = (frame(spark, n, s).na.fill(0.5) for n, s in ((400, 7), (200, 8)))
    prof = train.Profile(rf_trees=6, rf_max_depth=30)
    models, board = train.train_candidates(spark, rows, test, FEATURES, "y", 600, "t", names=["random_forest"],
                                           profile=prof)
    model = models["random_forest"]
    assert type(model).__name__ == "ForestModel" and board.first()["auc"] > 0.6
    assert (model.how.trees, model.how.depth) == (6, 30) and model.parts(spark).select("tree").distinct().count() == 6
    artifacts.save_run(spark, model, FEATURES, board.withColumn("chosen", F.lit(True)), str(tmp_path))
    assert scores(artifacts.load_model(spark, str(tmp_path)), test) == scores(model, test)
    small, _ = train.train_candidates(spark, rows.where("user_id < 200"), test, FEATURES, "y", 600, "t",
                                      names=["random_forest"], profile=prof)
    assert type(small["random_forest"]).__name__ == "PipelineModel"


def test_attributions_add_up_to_the_probability(spark, monkeypatch):
    monkeypatch.setattr(forest, "PART_ROWS", 60)
    df = frame(spark, 300, 9)
    model = forest.fit_forest(df, FEATURES, "y", how=Forest(trees=6, depth=7))
    assert model.parts(spark).count() > 6
    want = scores(model, df)
    got = explain.shap_values(spark, model, df, FEATURES, partitions=2).collect()
    assert len(got) == 300
    for r in got:
        assert r.base + sum(r[f"shap_{f}"] for f in FEATURES) == pytest.approx(want[r.user_id], abs=1e-6)
    assert explain.shap_importance(spark, model, df, FEATURES).count() == 4


def test_one_class(spark):
    df = frame(spark, 40, 1).withColumn("y", F.lit(1))
    model = forest.fit_forest(df, FEATURES, "y", how=Forest(trees=3))
    assert set(scores(model, df).values()) == {1.0} and prepare.SEED == 42
