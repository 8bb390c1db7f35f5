"""The daily batch: build gold models -> test them -> train, explain, save."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import explain, prepare, train
from ..ml.boosting import LEAST_ROWS
from ..ml.evaluate import score
from ..operators import quality as dq
from ..session import checkpoint_dir, collecting
from ..sources import artifacts, catalog
from ..sources.silver import Sources


@dataclass
class TrainingRun:
    feature_table: str
    features: list[str]
    table: DataFrame               # coerced features, lineage cut
    train: DataFrame
    test: DataFrame
    models: dict[str, PipelineModel]
    leaderboard: DataFrame
    champion: str
    out: str
    paths: dict = field(default_factory=dict)
    importance: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached splits; the written artifacts stay."""
        self.train.unpersist()
        self.test.unpersist()


def train_from_table(spark: SparkSession, table: DataFrame, table_name: str, out: str,
                     target: str = prepare.TARGET, profile: train.Profile | None = None,
                     shap_rows: int | None = None, checkpoint: bool = True) -> TrainingRun:
    """Coerce, split, fit the candidates, pick and save the champion, explain it.

    The coerced table is checkpointed to the shared checkpoint folder (reliable
    storage: lost executors do not force a rebuild of the gold models) unless
    ``checkpoint=False`` says the input already is; the two splits are cached
    because every candidate reads them, thousands of times, in partitions of
    ``LEAST_ROWS`` rows or more: the driver keeps a record of each task.  The champion is explained over all
    training rows, or over a seeded sample of ``shap_rows``.
    """
    checkpoint_dir(spark)
    coerced, feats = prepare.coerce_features(table, target=target)
    if checkpoint:
        coerced = coerced.checkpoint(eager=True)
    rows = coerced.count()
    tr, te = prepare.stratified_split(coerced, label=target)
    tr, te = (x.coalesce(max(1, -(-rows // LEAST_ROWS))).cache() for x in (tr, te))
    models, board = train.train_candidates(spark, tr, te, feats, target, rows, table_name, profile=profile)
    best = train.champion(board).first()
    chosen = best["model"]
    metrics = board.select("model", (F.col("model") == chosen).alias("chosen"), "train_order", "auc",
                           "accuracy", "rows", "target", "feature_table")
    paths = artifacts.save_run(spark, models[chosen], feats, metrics, out)
    run = TrainingRun(table_name, feats, coerced, tr, te, models, board, chosen, out, paths)
    if chosen in train.TREE_MODELS:
        # tree champions only, as in the original; failures must not fail the run
        try:
            with collecting(spark):
                imp = explain.shap_importance(spark, models[chosen].stages[-1], tr, feats, n=shap_rows,
                                              partitions=spark.sparkContext.defaultParallelism)
                paths[artifacts.IMPORTANCE] = artifacts.save_importance(imp, out)
            run.importance = artifacts.load_importance(spark, out)
        except Exception as e:  # noqa: BLE001
            run.importance = None
            paths["shap_error"] = str(e)
    return run


GOLD = "gold"
CURRENT = "gold_current"
CURRENT_SCHEMA = "model string, path string"


def write_gold(spark: SparkSession, models: dict[str, DataFrame], out: str) -> dict[str, str]:
    """Write every model as Parquet under a new folder of ``out``; ``{model: path}``."""
    run = f"{out.rstrip('/')}/{GOLD}/{uuid.uuid4().hex}"
    paths = {name: f"{run}/{name}" for name in models}
    for name, df in models.items():
        df.write.parquet(paths[name])
    return paths


def publish_gold(spark: SparkSession, paths: dict[str, str], out: str, tables: bool = False) -> None:
    """Make written models the current ones: one small file under ``out`` names them for
    later sessions (:func:`load_gold`), a view names them in this one.  ``tables`` also
    creates catalog tables over the written files (for a session with a metastore)."""
    from .reports import publish
    spark.createDataFrame(sorted(paths.items()), CURRENT_SCHEMA).coalesce(1).write.mode("overwrite").json(
        f"{out.rstrip('/')}/{CURRENT}")
    for name, path in paths.items():
        if tables:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            spark.catalog.createTable(name, path=path, source="parquet")
        else:
            publish(spark.read.parquet(path), name)


def load_gold(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The current models that an earlier batch wrote under ``out``."""
    rows = spark.read.schema(CURRENT_SCHEMA).json(f"{out.rstrip('/')}/{CURRENT}").collect()
    return {r["model"]: spark.read.parquet(r["path"]) for r in rows}


def run_daily_batch(spark: SparkSession, sf_dir: str | Sources, out: str, feature_table: str | None = None,
                    profile: train.Profile | None = None, shap_rows: int | None = None,
                    tables: bool = False, relationships: bool = False) -> tuple[DataFrame, TrainingRun]:
    """Write the gold models under ``out``, run the data-quality suite on the written
    tables, stop when a test fails (:class:`QualityGateError`, nothing is published),
    otherwise publish them and train on the first available feature table
    (``feature_table`` override first, then the gold one).

    ``relationships`` also stops the batch, before any model is built, when a row of the
    silver tables names a user or an order that is not there.  Each model is computed
    once; the suite, the training and later readers see the same written rows.
    """
    from .reports import gold_models
    src = sf_dir if isinstance(sf_dir, Sources) else Sources(spark, sf_dir)
    if relationships:
        dq.gate(dq.run_relationships({"users": src.users, "orders": src.orders, "order_items": src.items,
                                      "events": src.events}))
    with collecting(spark):
        paths = write_gold(spark, gold_models(src), out)
        report = dq.run_suite(spark, {name: spark.read.parquet(p) for name, p in paths.items()})
        dq.gate(report)
    publish_gold(spark, paths, out, tables)
    table, name = catalog.load_features(spark, (feature_table, catalog.DEFAULT_FEATURE_TABLE))
    written = feature_table is None or name == catalog.DEFAULT_FEATURE_TABLE
    run = train_from_table(spark, table, name, out, profile=profile, shap_rows=shap_rows, checkpoint=not written)
    return report, run


def champion_scores(run: TrainingRun) -> DataFrame:
    return score(run.models[run.champion], run.test, prepare.TARGET)
