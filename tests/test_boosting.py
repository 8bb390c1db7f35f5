import math

import numpy as np
import pytest

from kpiloom.ml import boosting, evaluate, explain
from kpiloom.ml.boosting import Boosting
from kpiloom.sources import artifacts

FEATURES = ["a", "b", "c", "d"]


def rows(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.random(n), np.zeros(n)])
    x[rng.random(n) < 0.03, 2] = np.nan
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] + (x[:, 1] > 2) - np.nan_to_num(x[:, 2]) - 0.5)))
    return [(i, *map(float, v), int(y)) for i, (v, y) in enumerate(zip(x, rng.random(n) < p))]


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, "user_id long, a double, b double, c double, d double, y int").repartition(parts)


def plain_boost(x, y, keys, cuts, how):
    """Every node by search over its rows: no histograms, no levels, no blocks."""
    share = y.mean()
    base = math.log(share / (1 - share))
    margin, scale, trees = np.full(len(y), base), 2.0 ** boosting.fixed_bits(len(y)), []
    for t in range(how.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * scale) / scale, np.rint(p * (1 - p) * scale) / scale
        used = boosting.drawn(keys, t, how.row_share, how.seed)
        columns = boosting.drawn_columns(x.shape[1], t, how.column_share, how.seed)
        leaves = []

        def split(mask, depth):
            rows_ = mask & used
            gs, hs = g[rows_].sum(), h[rows_].sum()
            best = (1e-9, None)
            for f in columns if depth else []:
                for c in cuts[f]:
                    left = mask & (x[:, f] <= c)
                    gl, hl = g[left & used].sum(), h[left & used].sum()
                    if min(hl, hs - hl) < how.min_hessian:
                        continue
                    gain = (gl ** 2 / (hl + how.l2) + (gs - gl) ** 2 / (hs - hl + how.l2) - gs ** 2 / (hs + how.l2)) / 2
                    if gain > best[0] and not math.isclose(gain, best[0], rel_tol=1e-13):
                        best = (gain, (f, c))
            if best[1] is None:
                leaves.append((mask, -how.rate * gs / (hs + how.l2)))
                return
            f, c = best[1]
            split(mask & (x[:, f] <= c), depth - 1)
            split(mask & ~(x[:, f] <= c), depth - 1)

        split(np.ones(len(y), bool), how.depth)
        for mask, value in leaves:
            margin[mask] += value
        trees.append(leaves)
    return margin


@pytest.mark.parametrize("parts,one_task", [(1, 0), (5, 0), (5, 1 << 16)])
def test_equals_a_plain_version(spark, monkeypatch, parts, one_task):
    monkeypatch.setattr(boosting, "ONE_TASK", one_task)
    data = rows(600, 1)
    how = Boosting(rounds=13, depth=3, rate=0.3, bins=16)
    df = frame(spark, data, parts)
    model = boosting.fit_boosted(df, FEATURES, "y", how=how)
    from pyspark.sql import functions as F
    got = df.select("user_id", F.xxhash64("user_id", *FEATURES).alias("k")).collect()
    key = {r.user_id: r.k for r in got}
    x = np.array([d[1:5] for d in data])
    y = np.array([d[5] for d in data], float)
    keys = np.array([key[d[0]] for d in data], np.int64).view(np.uint64)
    want = plain_boost(x, y, keys, boosting.quantile_cuts(df, FEATURES, how.bins), how)
    assert np.allclose(model.margins(x), want, rtol=0, atol=1e-9)
    scores = evaluate.score(model, df, "y")
    by_id = {r.user_id: r.score for r in scores.collect()}
    assert all(abs(by_id[i] - 1 / (1 + math.exp(-m))) < 1e-12 for i, m in enumerate(want))


def test_neither_partitioning_nor_passes_change_a_tree(spark, monkeypatch):
    how = Boosting(rounds=12, depth=4, bins=32)
    in_task = boosting.fit_boosted(frame(spark, rows(400, 2), 3), FEATURES, "y", how=how)
    monkeypatch.setattr(boosting, "ONE_TASK", 0)
    one, many = (boosting.fit_boosted(frame(spark, rows(400, 2), n), FEATURES, "y", how=how) for n in (1, 7))
    assert one.nodes() == many.nodes() == in_task.nodes()


def test_no_sums_reach_the_driver(spark, monkeypatch):
    """What a pass returns is a few numbers per node and feature, and no more for more partitions."""
    import pickle

    from pyspark import RDD
    monkeypatch.setattr(boosting, "ONE_TASK", 0)
    plain, sizes = RDD.collect, []

    def collect(self):
        got = plain(self)
        sizes.append(sum(len(pickle.dumps(x)) for x in got))
        return got
    monkeypatch.setattr(RDD, "collect", collect)
    model = boosting.fit_boosted(frame(spark, rows(4000, 7), 24), FEATURES, "y", how=Boosting(rounds=3, depth=4))
    assert len(model.trees) == 3 and len(sizes) >= 12
    assert max(sizes) < 16_000                 # a task's sums of the last level: 2 x 8 x 4 x 256 doubles


def test_learns_and_regularises(spark):
    train, test = frame(spark, rows(3000, 3)), frame(spark, rows(1500, 4))
    model = boosting.fit_boosted(train, FEATURES, "y", how=Boosting(rounds=40))
    assert evaluate.auc(evaluate.score(model, test, "y")) > 0.72
    stiff = boosting.fit_boosted(train, FEATURES, "y", how=Boosting(rounds=3, l2=1e9))
    assert max(abs(v[5]) for t in stiff.nodes() for v in t.values()) < 1e-4
    assert {v[2] for t in model.nodes() for v in t.values() if v[0] >= 0} <= {0, 1, 2}      # the constant is no split


def test_one_class_and_no_rows(spark):
    none = boosting.fit_boosted(frame(spark, []), FEATURES, "y")
    ones = boosting.fit_boosted(frame(spark, [(i, 1.0, 2.0, 3.0, 4.0, 1) for i in range(9)]), FEATURES, "y")
    assert none.trees == ones.trees == [] and ones.base > 10


def test_saved_model_scores_alike(spark, tmp_path):
    df = frame(spark, rows(300, 5))
    model = boosting.fit_boosted(df, FEATURES, "y", how=Boosting(rounds=5, depth=3))
    board = spark.createDataFrame([("m", True)], "model string, chosen boolean")
    artifacts.save_run(spark, model, FEATURES, board, str(tmp_path))
    again = artifacts.load_model(spark, str(tmp_path))
    assert again.nodes() == model.nodes() and again.how == model.how
    a, b = ({r.user_id: r.score for r in evaluate.score(m, df, "y").collect()} for m in (model, again))
    assert a == b


def test_attributions_add_up_to_the_margin(spark):
    df = frame(spark, rows(300, 6)).na.fill(0.5)
    model = boosting.fit_boosted(df, FEATURES, "y", how=Boosting(rounds=10, depth=4))
    got = {r.user_id: r for r in explain.shap_values(spark, model, df, FEATURES).collect()}
    x = {r.user_id: np.array([[r[f] for f in FEATURES]]) for r in df.collect()}
    for i, r in got.items():
        total = model.base + r.base + sum(r[f"shap_{f}"] for f in FEATURES)
        assert total == pytest.approx(model.margins(x[i])[0], abs=1e-9)


def test_tasks_of_a_pass_grow_with_the_rows_not_the_partitions(spark, monkeypatch):
    from pyspark import RDD
    assert [boosting.pass_tasks(n, 12) for n in (1, 72_000, 300_000, 10 ** 6, 10 ** 9)] == [1, 3, 10, 12, 954]
    monkeypatch.setattr(boosting, "ONE_TASK", 0)
    plain, parts = RDD.collect, []

    def collect(self):
        parts.append(self.getNumPartitions())
        return plain(self)
    monkeypatch.setattr(RDD, "collect", collect)
    boosting.fit_boosted(frame(spark, rows(400, 8), 9), FEATURES, "y", how=Boosting(rounds=2, depth=2))
    assert len(parts) >= 2 and set(parts) == {1}
