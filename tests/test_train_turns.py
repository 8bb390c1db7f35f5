"""What a training run leaves on the driver: passes in turn, tasks by rows, garbage collected."""

import time

import pytest

from kpiloom.ml import prepare, train
from kpiloom.plans import daily


def test_pass_models_take_turns_while_garbage_is_collected(spark, monkeypatch):
    spans, collected = {}, []

    class Fake:
        def __init__(self, name):
            self.name = name

        def fit(self, rows):
            began = time.monotonic()
            time.sleep(0.4)
            spans[self.name] = (began, time.monotonic())
            return self

    monkeypatch.setattr(train, "COLLECT_S", 0.1)
    monkeypatch.setattr(train, "collect_garbage", lambda s: collected.append(s))
    monkeypatch.setattr(train, "model_spec", lambda name, *a: Fake(name))
    monkeypatch.setattr(train, "fit_boosted", lambda rows, *a, **k: Fake("regularised_boosting").fit(rows))
    monkeypatch.setattr(train, "score", lambda m, rows, label: rows)
    monkeypatch.setattr(train, "measure", lambda s: {"auc": 0.5, "accuracy": 0.5})
    df = spark.createDataFrame([(1, 1.0, 1)], "user_id long, x double, y long")
    models, board = train.train_candidates(spark, df, df, ["x"], "y", 1, "t")
    assert list(models) == [r.model for r in board.orderBy("train_order").collect()] == list(train.CANDIDATES)
    one, two = sorted(spans[n] for n in train.PASS_MODELS)
    assert one[1] <= two[0]
    assert len(collected) >= 3 and all(s is spark for s in collected)


def test_a_failing_candidate_still_fails_the_run(spark, monkeypatch):
    def broken(*a, **k):
        raise RuntimeError("no fit")
    monkeypatch.setattr(train, "fit_boosted", broken)
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(8)], "user_id long, x double, y long")
    with pytest.raises(RuntimeError, match="no fit"):
        train.train_candidates(spark, df, df, ["x"], "y", 8, "t", names=("logistic_regression", "regularised_boosting"),
                               profile=train.Profile(lr_max_iter=1))


def test_partitions_of_the_splits_follow_the_rows(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def stop(spark, tr, te, *a, **k):
        seen.update({"train": (tr.rdd.getNumPartitions(), tr.count()), "test": (te.rdd.getNumPartitions(), te.count())})
        tr.unpersist()
        te.unpersist()
        raise Stop
    monkeypatch.setattr(train, "train_candidates", stop)
    monkeypatch.setattr(daily, "LEAST_ROWS", 40)
    table = spark.range(100, numPartitions=9).selectExpr("id as user_id", "cast(id as double) as x",
                                                         f"id % 2 as {prepare.TARGET}")
    with pytest.raises(Stop):
        daily.train_from_table(spark, table, "t", "unused")
    assert seen["train"][0] == seen["test"][0] == 3
    assert seen["train"][1] + seen["test"][1] == 100


def test_large_candidates_all_take_turns(spark, monkeypatch):
    spans, collected = [], []

    class Fake:
        def fit(self, rows):
            began = time.monotonic()
            time.sleep(0.2)
            spans.append((began, time.monotonic()))
            return self

    monkeypatch.setattr(train, "TOGETHER_ROWS", 2, raising=False)
    monkeypatch.setattr(train, "collect_garbage", lambda s: collected.append(s))
    monkeypatch.setattr(train, "model_spec", lambda *a: Fake())
    monkeypatch.setattr(train, "fit_boosted", lambda rows, *a, **k: Fake().fit(rows))
    monkeypatch.setattr(train, "score", lambda m, rows, label: rows)
    monkeypatch.setattr(train, "measure", lambda s: {"auc": 0.5, "accuracy": 0.5})
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(3)], "user_id long, x double, y long")
    models, board = train.train_candidates(spark, df, df, ["x"], "y", 3, "t")
    assert list(models) == [r.model for r in board.orderBy("train_order").collect()] == list(train.CANDIDATES)
    spans.sort()
    assert len(spans) == 4 and all(one[1] <= two[0] for one, two in zip(spans, spans[1:]))
    assert len(collected) >= 4


def test_garbage_is_collected_around_a_step(spark, monkeypatch):
    from kpiloom import session
    collected = []
    monkeypatch.setattr(session, "collect_garbage", collected.append)
    with pytest.raises(RuntimeError, match="no step"), session.collecting(spark, 0.05):
        time.sleep(0.5)
        raise RuntimeError("no step")
    n = len(collected)
    assert n >= 3 and all(s is spark for s in collected)
    time.sleep(0.2)
    assert len(collected) == n
