"""Reports on scorers with fixed coefficients: a whole run (scoring, leaderboard, champion,
saved artifacts, explanation) whose every number SQL can repeat."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ml import prepare, train
from ..ml.evaluate import evaluate_scores, measure, score
from ..ml.linear import LinearScorer
from ..session import scratch_path
from ..sources import artifacts
from ..sources.silver import Sources
from .reports import _state_of, _written_features, report
from .scorers import SCORERS

FEATURE_TABLE = "features_conversion"
_RUN: dict = {}


def _run(src: Sources) -> tuple[str, DataFrame, DataFrame]:
    """(folder of the saved run, feature table, test split); shared by the reports."""
    key = src if src.given else _state_of(src)
    if key not in _RUN:
        spark, table = src.spark, _written_features(src)
        tr, te = prepare.stratified_split(table)
        te, rows = te.checkpoint(eager=True), table.count()
        models, board = {}, []
        for i, (name, (intercept, weights)) in enumerate(SCORERS.items()):
            models[name] = LinearScorer(intercept, weights)
            got = measure(score(models[name], te, prepare.TARGET))
            board.append((i, name, got["auc"], got["accuracy"], rows, prepare.TARGET, FEATURE_TABLE))
        board = spark.createDataFrame(board, train.LEADERBOARD_SCHEMA)
        chosen = train.champion(board).first()["model"]
        out = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
        metrics = board.withColumn("chosen", F.col("model") == chosen)
        artifacts.save_run(spark, models[chosen], list(models[chosen].weights), metrics, out)
        artifacts.save_importance(models[chosen].importance(tr), out)
        _RUN.clear()
        _RUN[key] = (out, table, te)
    return _RUN[key]


@report("ml_fixed_metrics")
def _ml_fixed_metrics(src: Sources) -> DataFrame:
    """The saved leaderboard, read back."""
    return artifacts.load_metrics(src.spark, _run(src)[0])


@report("ml_fixed_scores")
def _ml_fixed_scores(src: Sources) -> DataFrame:
    """Scores of the saved champion on the test split."""
    out, _, test = _run(src)
    return score(artifacts.load_model(src.spark, out), test, prepare.TARGET)


@report("ml_fixed_evaluate")
def _ml_fixed_evaluate(src: Sources) -> DataFrame:
    """The saved champion evaluated on the whole feature table."""
    out, table, _ = _run(src)
    return evaluate_scores(src.spark, score(artifacts.load_model(src.spark, out), table, prepare.TARGET))


@report("ml_fixed_importance")
def _ml_fixed_importance(src: Sources) -> DataFrame:
    """The saved explanation of the champion over the training rows, read back, with the
    position of each feature in the saved column list."""
    out = _run(src)[0]
    columns = artifacts.load_columns(src.spark, out)
    place = src.spark.createDataFrame(list(enumerate(columns)), artifacts.COLUMNS_SCHEMA)
    return artifacts.load_importance(src.spark, out).join(place, "feature").select(
        "feature", "mean_abs_shap", "position")
