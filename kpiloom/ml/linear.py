"""Linear scorers with given coefficients: a score that SQL can repeat.

They stand in a run like fitted models: scored, compared, saved, read back and
explained by the same functions.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COEFFICIENTS = "position int, feature string, weight double"


class LinearScorer:
    """Margin = intercept + sum of weight x feature, added in the order given."""

    def __init__(self, intercept: float, weights: dict[str, float]):
        self.intercept, self.weights = float(intercept), {f: float(w) for f, w in weights.items()}
        self.stages = [self]

    def margin(self) -> Column:
        m = F.lit(self.intercept)
        for f, w in self.weights.items():
            m = m + F.col(f).cast("double") * F.lit(w)
        return m

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction``, the margins of both classes."""
        m = self.margin()
        return df.withColumn("rawPrediction", array_to_vector(F.array(-m, m)))

    def importance(self, df: DataFrame) -> DataFrame:
        """``(feature, mean_abs_shap)``, descending.  A linear score's Shapley values are
        weight x (value - mean), so two aggregates explain every row exactly."""
        means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in self.weights]).first()
        parts = df.agg(*[F.avg(F.abs((F.col(f).cast("double") - F.lit(means[f])) * F.lit(w))).alias(f)
                         for f, w in self.weights.items()])
        rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap")) for f in self.weights])
        return parts.select(F.inline(rows)).orderBy(F.desc("mean_abs_shap"), F.asc("feature"))

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearScorer:
        rows = spark.read.schema(_COEFFICIENTS).parquet(f"{path}/coefficients").orderBy("position").collect()
        return cls(rows[0].weight, {r.feature: r.weight for r in rows[1:]})


class _Writer:
    """Saves a scorer in the way a pipeline is saved: ``write().overwrite().save(path)``."""

    def __init__(self, model: LinearScorer):
        self.model, self.mode = model, "error"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        rows = [(0, None, self.model.intercept)] + [(i, f, w) for i, (f, w) in enumerate(self.model.weights.items(), 1)]
        SparkSession.active().createDataFrame(rows, _COEFFICIENTS).coalesce(1).write.mode(self.mode).parquet(
            f"{path}/coefficients")
