"""Candidate models, training, leaderboard and champion selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import COLLECT_S, collect_garbage
from .boosting import Boosting, fit_boosted
from .evaluate import measure, score
from .forest import Forest, fit_forest
from .prepare import SEED

FEATURES_VEC = "features"

# Fixed hyper-parameters of the candidates, in training order.
LR_MAX_ITER = 1000
LR_C = 1.0                 # inverse L2 strength of the original; regParam = 1 / (C * n)
RF_TREES = 200
RF_MAX_DEPTH = 30          # the library's largest; the original has no limit
RF_LIBRARY_ROWS = 4096     # training rows up to which MLlib's forest, held by the driver, is fitted; then ml/forest.py
GBT_ROUNDS = 200
GBT_DEPTH = 5
GBT_STEP = 0.08
GBT_ROW_SAMPLE = 0.9
GBT_COL_SAMPLE = "0.9"
CANDIDATES = ("logistic_regression", "random_forest", "gradient_boosting", "regularised_boosting")
TOGETHER_ROWS = RF_LIBRARY_ROWS     # training rows up to which candidates are fitted at the same time
PASS_MODELS = ("gradient_boosting", "regularised_boosting")     # a small distributed pass per level of each tree
TREE_MODELS = ("random_forest", "gradient_boosting", "regularised_boosting")


@dataclass
class Profile:
    rf_trees: int = RF_TREES
    rf_max_depth: int = RF_MAX_DEPTH
    gbt_rounds: int = GBT_ROUNDS
    lr_max_iter: int = LR_MAX_ITER


def estimator(name: str, label: str, n_train: int, profile: Profile | None = None):
    p = profile or Profile()
    if name == "logistic_regression":
        # L2 with C = 1 on the summed log-loss == MLlib's mean loss with regParam = 1 / (C n);
        # no standardisation, like the original
        return LogisticRegression(featuresCol=FEATURES_VEC, labelCol=label, maxIter=p.lr_max_iter,
                                  regParam=1.0 / (LR_C * max(n_train, 1)), elasticNetParam=0.0,
                                  standardization=False)
    if name == "random_forest":
        return RandomForestClassifier(featuresCol=FEATURES_VEC, labelCol=label, numTrees=p.rf_trees,
                                      maxDepth=p.rf_max_depth, featureSubsetStrategy="sqrt", seed=SEED)
    if name == "gradient_boosting":
        # gradient-boosted trees with the original's rounds, depth, rate and row/column sampling
        return GBTClassifier(featuresCol=FEATURES_VEC, labelCol=label, maxIter=p.gbt_rounds,
                             maxDepth=GBT_DEPTH, stepSize=GBT_STEP, subsamplingRate=GBT_ROW_SAMPLE,
                             featureSubsetStrategy=GBT_COL_SAMPLE, seed=SEED)
    raise KeyError(f"unknown model {name!r}")


def model_spec(name: str, features: list[str], label: str, n_train: int, profile: Profile | None = None) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES_VEC, handleInvalid="keep")
    return Pipeline(stages=[assembler, estimator(name, label, n_train, profile)])


LEADERBOARD_SCHEMA = T.StructType([
    T.StructField("train_order", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("rows", T.LongType()),
    T.StructField("target", T.StringType()),
    T.StructField("feature_table", T.StringType()),
])


def train_candidates(spark: SparkSession, train: DataFrame, test: DataFrame, features: list[str],
                     label: str, rows: int, feature_table: str, names=CANDIDATES,
                     profile: Profile | None = None, parallel: bool = True
                     ) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every candidate on ``train``, score ``test``; returns the fitted
    pipelines and the leaderboard ``(train_order, model, auc, accuracy, rows,
    target, feature_table)``, one row per model (``rows`` = whole table).

    The candidates are independent, so up to ``TOGETHER_ROWS`` training rows they are
    fitted concurrently from driver threads (each fit is itself distributed); seeds are
    fixed, so the result does not depend on the interleaving.  The boosted ones, of a
    thousand small passes each, take turns: every pass leaves garbage on the driver, whose
    heap grows with the passes that run at a time.  Above that all take turns, as each has
    work for the whole cluster, and the driver then holds the plans, tasks and buffers of
    one fit.  While they run the driver's garbage is collected every ``COLLECT_S``
    seconds, and after each turn.
    """
    n_train = train.count()
    names = list(names)

    def fit(i_name):
        i, name = i_name
        if name == "regularised_boosting":
            how = Boosting(rounds=(profile or Profile()).gbt_rounds, depth=GBT_DEPTH, rate=GBT_STEP,
                           row_share=GBT_ROW_SAMPLE, column_share=float(GBT_COL_SAMPLE), seed=SEED)
            m = fit_boosted(train, features, label, how=how)
        elif name == "random_forest" and n_train > RF_LIBRARY_ROWS:
            p = profile or Profile()
            m = fit_forest(train, features, label, how=Forest(trees=p.rf_trees, depth=p.rf_max_depth, seed=SEED))
        else:
            m = model_spec(name, features, label, n_train, profile).fit(train)
        s = score(m, test, label).persist()           # scored once for all metrics
        try:
            got = measure(s)
        finally:
            s.unpersist()
        return name, m, (i, name, got["auc"], got["accuracy"], int(rows), label, feature_table)

    if parallel and len(names) > 1:
        from concurrent.futures import ThreadPoolExecutor, wait
        turns = [x for x in enumerate(names) if n_train > TOGETHER_ROWS or x[1] in PASS_MODELS]
        lanes = [[x] for x in enumerate(names) if x not in turns] + [turns] * bool(turns)

        def in_turn(lane):
            got = []
            for x in lane:
                got.append((x[0], fit(x)))
                collect_garbage(spark)
            return got

        with ThreadPoolExecutor(max_workers=len(lanes)) as pool:
            running = [pool.submit(in_turn, lane) for lane in lanes]
            while wait(running, timeout=COLLECT_S).not_done:
                collect_garbage(spark)
        results = [r for _, r in sorted((r for lane in running for r in lane.result()), key=lambda r: r[0])]
    else:
        results = [fit(x) for x in enumerate(names)]
    models = {name: m for name, m, _ in results}
    board = [row for _, _, row in results]
    return models, spark.createDataFrame(board, LEADERBOARD_SCHEMA)


def champion(leaderboard: DataFrame) -> DataFrame:
    """Best AUC; ties -> best accuracy; ties -> first trained.  Raises when empty."""
    best = leaderboard.orderBy(F.desc("auc"), F.desc("accuracy"), F.asc("train_order")).limit(1)
    if best.isEmpty():
        raise ValueError("no models trained successfully")
    return best
