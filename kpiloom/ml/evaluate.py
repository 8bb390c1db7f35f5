"""Scoring and evaluation metrics."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.5


def score(model, df: DataFrame, label: str, id_col: str = "user_id") -> DataFrame:
    """``(id, label, score)``: the positive-class probability of a fitted
    pipeline; a model without probabilities falls back to the logistic squash of
    its raw score, and to the predicted class last."""
    out = model.transform(df)
    if "probability" in out.columns:
        s = vector_to_array(F.col("probability"))[1]
    elif "rawPrediction" in out.columns:
        raw = vector_to_array(F.col("rawPrediction"))[1]
        s = F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))
    else:
        s = F.col("prediction").cast("double")
    keep = [c for c in (id_col,) if c in out.columns]
    return out.select(*keep, F.col(label).cast("double").alias("label"), s.alias("score"))


def measure(scores: DataFrame, label: str = "label", score_col: str = "score",
            threshold: float = THRESHOLD) -> dict:
    """rows, positives, accuracy and exact ROC AUC of a score.

    Counts and accuracy come from one aggregate.  The AUC counts ties one half and is
    None when a class is missing (it is undefined there); ``numBins=0`` keeps every
    distinct score: MLlib groups scores, sorts them with a range partitioner and
    accumulates per-partition counts, so no step holds all scores in one task.
    """
    y = F.col(label).cast("double")
    right = ((F.col(score_col) >= threshold).cast("double") == y).cast("double")
    c = scores.agg(F.count(F.lit(1)).alias("rows"), F.count_if(y == 1).alias("positives"),
                   F.count_if(y == 0).alias("negatives"), F.avg(right).alias("accuracy")).first()
    area = None
    if c["positives"] and c["negatives"]:
        ev = BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol=label,
                                           metricName="areaUnderROC", numBins=0)
        area = float(ev.evaluate(scores.select(F.col(score_col).cast("double").alias(score_col), y.alias(label))))
    return {"rows": c["rows"], "positives": c["positives"], "accuracy": c["accuracy"], "auc": area}


def auc(scores: DataFrame, label: str = "label", score_col: str = "score") -> float | None:
    return measure(scores, label, score_col)["auc"]


def accuracy_frame(scores: DataFrame, label: str = "label", score_col: str = "score",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Accuracy with a score at or above ``threshold`` predicted positive (ties
    positive; MLlib's own ``prediction`` uses ``>``)."""
    pred = (F.col(score_col) >= threshold).cast("double")
    return scores.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((pred == F.col(label).cast("double")).cast("double")).alias("accuracy"),
    )


def accuracy(scores: DataFrame, label: str = "label", score_col: str = "score",
             threshold: float = THRESHOLD) -> float:
    return float(accuracy_frame(scores, label, score_col, threshold).first()["accuracy"])


METRICS_SCHEMA = T.StructType([
    T.StructField("rows", T.LongType()),
    T.StructField("positives", T.LongType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
])


def evaluate_scores(spark: SparkSession, scores: DataFrame, label: str = "label",
                    score_col: str = "score") -> DataFrame:
    """One row: rows, positives, exact AUC and accuracy at >= 0.5."""
    m = measure(scores, label, score_col)
    return spark.createDataFrame([(int(m["rows"]), int(m["positives"]), m["auc"], m["accuracy"])], METRICS_SCHEMA)
