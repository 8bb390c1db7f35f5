"""Run artifacts on shared storage: champion model, feature manifest, metrics
and feature importance."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MODEL = "model"
COLUMNS = "columns"
METRICS = "metrics"
IMPORTANCE = "shap_importance"

COLUMNS_SCHEMA = T.StructType([T.StructField("position", T.IntegerType()),
                               T.StructField("feature", T.StringType())])
METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("chosen", T.BooleanType()),
    T.StructField("train_order", T.IntegerType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("rows", T.LongType()),
    T.StructField("target", T.StringType()),
    T.StructField("feature_table", T.StringType()),
])
IMPORTANCE_SCHEMA = T.StructType([T.StructField("feature", T.StringType()),
                                  T.StructField("mean_abs_shap", T.DoubleType())])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_run(spark: SparkSession, model: PipelineModel, columns: list[str], metrics: DataFrame, path: str) -> dict:
    """Write the champion pipeline, the ordered feature manifest and the metrics
    (every model plus the chosen one).  Returns the written paths."""
    paths = {k: os.path.join(path, k) for k in (MODEL, COLUMNS, METRICS)}
    model.write().overwrite().save(paths[MODEL])
    spark.createDataFrame(list(enumerate(columns)), COLUMNS_SCHEMA).coalesce(1).write.mode("overwrite").json(
        paths[COLUMNS])
    metrics.coalesce(1).write.mode("overwrite").json(paths[METRICS])
    return paths


def save_importance(importance: DataFrame, path: str) -> str:
    out = os.path.join(path, IMPORTANCE)
    importance.coalesce(1).write.mode("overwrite").json(out)
    return out


def _read(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    p = os.path.join(path, name)
    if not _exists(spark, p):
        raise FileNotFoundError(f"no {name} artifact under {path}")
    return spark.read.schema(schema).json(p)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, METRICS, METRICS_SCHEMA)


def load_columns(spark: SparkSession, path: str) -> list[str]:
    rows = _read(spark, path, COLUMNS, COLUMNS_SCHEMA).orderBy("position").collect()
    return [r["feature"] for r in rows]


def load_importance(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, IMPORTANCE, IMPORTANCE_SCHEMA)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    p = os.path.join(path, MODEL)
    if not _exists(spark, p):
        raise FileNotFoundError(f"no model artifact under {path}")
    if _exists(spark, os.path.join(p, "nodes")):
        from ..ml.boosting import BoostedModel
        return BoostedModel.load(spark, p)
    if _exists(spark, os.path.join(p, "parts")):
        from ..ml.forest import ForestModel
        return ForestModel.load(spark, p)
    if _exists(spark, os.path.join(p, "coefficients")):
        from ..ml.linear import LinearScorer
        return LinearScorer.load(spark, p)
    return PipelineModel.load(p)
