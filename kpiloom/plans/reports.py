"""Named reports: the registry behind ``run_report`` and ``queries()``.

Each report is a function of the silver :class:`Sources` plus typed keyword
parameters and returns a lazy DataFrame.  Ordering and paging happen here, not
in the models (a model's row order is not a contract).
"""

from __future__ import annotations

import datetime as _dt
import inspect
import re
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assignment as asg
from ..operators import experiments as exp
from ..operators import features as feat
from ..operators import funnel as fun
from ..operators import quality as dq
from ..operators import retention as ret
from ..operators import revenue as rev
from ..functions.dates import day_of
from ..session import scratch_path
from ..sources.silver import Sources

Report = Callable[..., DataFrame]
REGISTRY: dict[str, Report] = {}

# Fixed values of the original reports.
PAGE = 5000            # page size of the list reports
LAST_DAYS = 7          # "last n days" report
MAX_WEEK = 12          # retention pivot columns week_0..week_12


def report(name: str):
    def deco(fn: Report) -> Report:
        REGISTRY[name] = fn
        return fn
    return deco


def publish(df: DataFrame, name: str) -> DataFrame:
    """Publish a model under a view name (session-scoped temp view)."""
    df.createOrReplaceTempView(name)
    return df


# -- silver -------------------------------------------------------------------

@report("silver_users")
def _silver_users(src: Sources) -> DataFrame:
    return src.users


@report("silver_orders")
def _silver_orders(src: Sources) -> DataFrame:
    return src.orders


@report("silver_order_items")
def _silver_items(src: Sources) -> DataFrame:
    return src.items


@report("silver_events")
def _silver_events(src: Sources) -> DataFrame:
    return src.events


# -- gold models ----------------------------------------------------------------

@report("revenue_daily")
def _revenue_daily(src: Sources) -> DataFrame:
    return rev.revenue_daily(src.orders, src.items)


@report("revenue_daily_completed")
def _revenue_daily_completed(src: Sources) -> DataFrame:
    return rev.revenue_daily_completed(src.orders, src.items)


@report("funnel_users")
def _funnel_users(src: Sources) -> DataFrame:
    return fun.funnel_users(src.users, src.events, src.orders)


@report("funnel_event_set")
def _funnel_event_set(src: Sources) -> DataFrame:
    return fun.funnel_event_set(src.events, src.orders)


@report("retention_weekly")
def _retention_weekly(src: Sources) -> DataFrame:
    return ret.retention_weekly(src.users, src.events)


@report("retention_unbounded")
def _retention_unbounded(src: Sources) -> DataFrame:
    return ret.retention_unbounded(src.users, src.events)


@report("features_last_event")
def _features_last_event(src: Sources) -> DataFrame:
    return feat.last_event(src.events)


@report("features_rfm")
def _features_rfm(src: Sources) -> DataFrame:
    return feat.rfm(src.users, src.orders, src.items, feat.last_event(src.events))


@report("features_source_mix")
def _features_source_mix(src: Sources) -> DataFrame:
    return feat.source_mix(src.events)


@report("features_label")
def _features_label(src: Sources) -> DataFrame:
    return feat.conversion_label(feat.last_event(src.events), src.orders)


@report("features_conversion")
def _features_conversion(src: Sources) -> DataFrame:
    return feat.features_conversion(src.users, src.orders, src.items, src.events)


@report("ab_group")
def _ab_group(src: Sources, method: str = "md5") -> DataFrame:
    return asg.ab_group(src.users, method=method)


@report("ab_metrics")
def _ab_metrics(src: Sources) -> DataFrame:
    return asg.ab_metrics_from_users(src.users, src.events, src.orders)


# -- reports --------------------------------------------------------------------

@report("revenue_daily_range")
def _revenue_daily_range(src: Sources, start: _dt.date | None = None, end: _dt.date | None = None) -> DataFrame:
    """Daily revenue, oldest first; ``start`` and ``end`` are inclusive, and a bound
    that is not given stays open.  A given bound is a plain filter on the day, which
    Catalyst moves through the aggregate and the join to the orders scan."""
    days = _revenue_daily(src)
    if start is not None:
        days = days.where(F.col("day") >= F.lit(start))
    if end is not None:
        days = days.where(F.col("day") <= F.lit(end))
    return days.orderBy("day")


def _page(df: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    # ordered page: TakeOrderedAndProject keeps a per-task top-k, never a full sort
    return df.orderBy(key).limit(limit)


def _only(ids: DataFrame, table: DataFrame, key: str) -> list[DataFrame]:
    """``table`` reduced to the ids of a page.  Spark knows the size of a limited result, and
    broadcasts the ids when that is small; a huge ``limit`` gives a shuffle join."""
    keys = ids.select(F.col("user_id").alias("_page_id"))
    return [table.join(keys, F.col(key).eqNullSafe(F.col("_page_id")), "left_semi")]


@report("funnel_users_page")
def _funnel_users_page(src: Sources, limit: int = PAGE) -> DataFrame:
    ids = _page(src.users.select(F.col("id").alias("user_id")).distinct(), limit)
    return _page(fun.funnel_users(*_only(ids, src.users, "id"), *_only(ids, src.events, "user_id"),
                                  *_only(ids, src.orders, "user_id")), limit)


@report("retention_weekly_sorted")
def _retention_sorted(src: Sources) -> DataFrame:
    return _retention_weekly(src).orderBy("cohort_week", "week_n")


@report("ab_group_page")
def _ab_group_page(src: Sources, limit: int = PAGE) -> DataFrame:
    return _page(_ab_group(src), limit)


@report("ab_metrics_sorted")
def _ab_metrics_sorted(src: Sources) -> DataFrame:
    return _ab_metrics(src).orderBy("ab_group")


@report("features_page")
def _features_page(src: Sources, limit: int = PAGE) -> DataFrame:
    # a user has features when it has an event; one user row per signup day at least,
    # so the first ``limit`` such ids cover the page
    ids = src.users.select(F.col("id").alias("user_id")).join(
        src.events.select("user_id"), "user_id", "left_semi").distinct()
    ids = _page(ids, limit)
    # the page's orders are written, so their size is known when their items are looked up:
    # of few orders, the ids are broadcast and the items are never exchanged
    path = scratch_path(src.spark, f"pages/{uuid.uuid4().hex}")
    _only(ids, src.orders, "user_id")[0].write.parquet(path)
    orders = src.spark.read.parquet(path)
    items = src.items.join(orders.select("order_id"), "order_id", "left_semi")
    return _page(feat.features_conversion(*_only(ids, src.users, "id"), orders, items,
                                          *_only(ids, src.events, "user_id")), limit)


@report("revenue_last_7")
def _revenue_last_7(src: Sources, n: int = LAST_DAYS) -> DataFrame:
    return _revenue_daily_completed(src).orderBy(F.desc("day")).limit(n)


@report("funnel_counts")
def _funnel_counts(src: Sources) -> DataFrame:
    f = _funnel_event_set(src)
    return f.agg(
        F.sum(F.col("saw_landing").cast("bigint")).alias("landing_users"),
        F.sum(F.col("saw_product").cast("bigint")).alias("product_users"),
        F.sum(F.col("saw_cart").cast("bigint")).alias("cart_users"),
        F.sum(F.col("converted").cast("bigint")).alias("purchasers"),
    )


@report("ab_metrics_event_users")
def _ab_metrics_event_users(src: Sources) -> DataFrame:
    return asg.ab_metrics(_funnel_event_set(src), _ab_group(src))


FUNNEL_STEPS = ["visited", "added_to_cart", "converted"]


@report("funnel_rates")
def _funnel_rates(src: Sources) -> DataFrame:
    """Funnel status as counts and as shares of all users: one row per step."""
    f = _funnel_users(src)
    totals = f.agg(
        F.count(F.lit(1)).alias("all_users"),
        *[F.count_if(F.col(s)).alias(s) for s in FUNNEL_STEPS],
    )
    steps = ["all_users"] + FUNNEL_STEPS
    stack = "stack({n}, {items}) as (step_order, step, users)".format(
        n=len(steps), items=", ".join(f"{i}, '{s}', `{s}`" for i, s in enumerate(steps)))
    long = totals.select(F.col("all_users").alias("_total"), F.expr(stack))
    return long.select(
        F.col("step_order").cast("int").alias("step_order"), "step",
        F.col("users").cast("bigint").alias("users"),
        F.try_divide(F.col("users"), F.col("_total")).alias("share"),
    )


@report("retention_pivot")
def _retention_pivot(src: Sources, max_week: int = MAX_WEEK) -> DataFrame:
    """Cohort table: one row per cohort week, columns week_0 .. week_<max_week>.

    The pivot values are given, so no extra job collects the distinct weeks.
    """
    r = ret.retention_weekly(src.users, src.events, bounds=(0, max_week))
    p = r.groupBy("cohort_week").pivot("week_n", list(range(max_week + 1))).agg(F.first("retention_rate"))
    return p.select("cohort_week", *[F.col(str(k)).alias(f"week_{k}") for k in range(max_week + 1)])


# -- experiments --------------------------------------------------------------

@report("ab_pivot")
def _ab_pivot(src: Sources) -> DataFrame:
    return exp.ab_pivot(_ab_metrics(src))


@report("ab_uplift")
def _ab_uplift(src: Sources) -> DataFrame:
    return exp.ab_uplift(_ab_metrics(src))


@report("ab_bucket_share")
def _ab_bucket_share(src: Sources) -> DataFrame:
    return exp.ab_bucket_share(_ab_group(src))


@report("ab_test")
def _ab_test(src: Sources, alpha: float = exp.DEFAULT_ALPHA) -> DataFrame:
    return exp.ab_test(exp.ab_pivot(_ab_metrics(src)), alpha)


@report("ab_srm")
def _ab_srm(src: Sources) -> DataFrame:
    return _ab_test(src).select("a_total", "b_total", "srm_chi2", "srm_p")


@report("ab_test_invalid")
def _ab_test_segments(src: Sources, alpha: float = exp.DEFAULT_ALPHA) -> DataFrame:
    """The test per signup-day segment: small segments (nobody converted, or one
    group empty) come out ``valid = false`` with null statistics."""
    m = asg.ab_metrics_from_users(src.users, src.events, src.orders,
                                  keys={"signup_day": day_of("created_at")})
    return exp.ab_test(exp.ab_pivot(m, keys=["signup_day"]), alpha)


@report("ab_verdict")
def _ab_verdict(src: Sources, alpha: float = exp.DEFAULT_ALPHA) -> DataFrame:
    """Verdict on the first-generation metrics (users with events)."""
    return exp.ab_verdict(exp.ab_test(exp.ab_pivot(_ab_metrics_event_users(src)), alpha))


@report("ab_experiment")
def _ab_experiment(src: Sources, alpha: float = exp.DEFAULT_ALPHA) -> DataFrame:
    return exp.run_experiment(src.users, src.events, src.orders, alpha)


# -- data quality -------------------------------------------------------------

GOLD_MODELS: dict[str, Report] = {
    "revenue_daily": _revenue_daily,
    "funnel_users": _funnel_users,
    "ab_group": _ab_group,
    "ab_metrics": _ab_metrics,
    "retention_weekly": _retention_weekly,
    "features_conversion": _features_conversion,
}


class LazyModels(dict):
    """Gold models by name, each built when first asked for."""

    def __init__(self, src: Sources):
        super().__init__()
        self.src = src

    def __contains__(self, name):
        return name in GOLD_MODELS

    def __missing__(self, name):
        self[name] = GOLD_MODELS[name](self.src)
        return self[name]


def gold_models(src: Sources) -> dict[str, DataFrame]:
    """The six gold models, each built once, exactly as their reports build them."""
    return {name: make(src) for name, make in GOLD_MODELS.items()}


@report("dq_report")
def _dq_report(src: Sources) -> DataFrame:
    return dq.run_suite(src.spark, gold_models(src))


@report("dq_not_null")
def _dq_not_null(src: Sources) -> DataFrame:
    return dq.run_suite(src.spark, LazyModels(src), only="not_null")


@report("dq_accepted_values")
def _dq_accepted(src: Sources) -> DataFrame:
    return dq.run_suite(src.spark, LazyModels(src), only="accepted_values")


# -- model training -----------------------------------------------------------

BASELINE_AUC_SCORE = "orders_30d"      # single-feature scores that check the metric
BASELINE_ACC_SCORE = "pct_direct"      # operators against SQL (model scores have no oracle)
RUNS_KEPT = 4
_RUNS: dict = {}
_GIVEN_RUNS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _coerced(src: Sources) -> DataFrame:
    from ..ml import prepare
    return prepare.coerce_features(_features_conversion(src))[0]


def _written_features(src: Sources) -> DataFrame:
    """The coerced features, computed once: the split's counting passes and the report
    read them from the shared checkpoint folder."""
    from ..session import checkpoint_dir
    checkpoint_dir(src.spark)
    return _coerced(src).checkpoint(eager=True)


@report("features_coerced")
def _features_coerced(src: Sources) -> DataFrame:
    return _coerced(src)


@report("ml_split")
def _ml_split(src: Sources) -> DataFrame:
    from ..ml import prepare
    return prepare.assign_split(_written_features(src)).select("user_id", prepare.TARGET, "split")


def _baseline_test_scores(src: Sources, score_col: str) -> DataFrame:
    from ..ml import prepare
    test = prepare.stratified_split(_written_features(src))[1]
    return test.select("user_id", F.col(prepare.TARGET).cast("double").alias("label"),
                       F.col(score_col).cast("double").alias("score"))


@report("ml_auc")
def _ml_auc(src: Sources, score_col: str = BASELINE_AUC_SCORE) -> DataFrame:
    """Exact AUC of a score on the test split (here a single-feature score)."""
    from ..ml.evaluate import evaluate_scores
    m = evaluate_scores(src.spark, _baseline_test_scores(src, score_col))
    return m.select("rows", "positives", "auc")


@report("ml_accuracy")
def _ml_accuracy(src: Sources, score_col: str = BASELINE_ACC_SCORE) -> DataFrame:
    from ..ml.evaluate import accuracy_frame
    return accuracy_frame(_baseline_test_scores(src, score_col))

@report("ml_evaluate_score")
def _ml_evaluate_score(src: Sources, score_col: str = BASELINE_ACC_SCORE) -> DataFrame:
    """Rows, positives, AUC and accuracy of a fixed score over the whole feature table."""
    from ..ml import prepare
    from ..ml.evaluate import evaluate_scores
    rows = _written_features(src).select(F.col(prepare.TARGET).cast("double").alias("label"),
                                         F.col(score_col).alias("score"))
    return evaluate_scores(src.spark, rows)


def _feature_board(src: Sources) -> DataFrame:
    """A leaderboard whose candidates are the single features, on the test split."""
    from ..ml import prepare, train
    from ..ml.evaluate import measure
    rows = _written_features(src)
    test = prepare.stratified_split(rows)[1].checkpoint(eager=True)
    n, board = rows.count(), []
    for i, f in enumerate(prepare.feature_columns(rows)):
        got = measure(test.select(F.col(prepare.TARGET).cast("double").alias("label"), F.col(f).alias("score")))
        board.append((i, f, got["auc"], got["accuracy"], n, prepare.TARGET, "features_conversion"))
    return src.spark.createDataFrame(board, train.LEADERBOARD_SCHEMA)


@report("ml_feature_board")
def _ml_feature_board(src: Sources) -> DataFrame:
    return _feature_board(src)


@report("ml_feature_champion")
def _ml_feature_champion(src: Sources) -> DataFrame:
    from ..ml import train
    return train.champion(_feature_board(src))


@report("event_type_sets")
def _event_type_sets(src: Sources) -> DataFrame:
    """Each user's set of event types, and membership of the first-generation steps."""
    sets = fun.event_type_sets(src.events)
    return sets.select("user_id", F.array_join("events", ",").alias("events"),
                       F.size("events").cast("bigint").alias("n_types"),
                       *[F.array_contains("events", t).alias(k) for k, t in fun.FIRST_GEN_STEPS.items()])


@report("features_text_coerced")
def _features_text_coerced(src: Sources) -> DataFrame:
    """Feature coercion of text, list, boolean and nested cells, on the events table."""
    from ..ml import prepare
    k = F.get_json_object("props", "$.k")
    cells = src.events.select(
        F.col("event_id"), F.concat(F.lit("  "), k, F.lit(" ")).alias("padded"),
        F.concat(F.lit("["), k, F.lit(".5]")).alias("bracketed"), F.concat(k, F.lit("d")).alias("suffixed"),
        F.concat(F.lit("1_"), k).alias("grouped"), F.concat(k, F.lit("e1")).alias("scientific"),
        F.array(F.col("value"), F.lit(0.0)).alias("listed"), F.array().cast("array<double>").alias("no_list"),
        F.array(F.array(F.concat(F.lit(" "), k))).alias("nested"), (F.col("value") > 50).alias("large"),
        F.lit(None).cast("string").alias("missing"), F.col("event_type").alias("word"),
        (F.col("event_type") == "purchase").cast("int").alias("bought"))
    return prepare.coerce_features(cells, id_cols=("event_id",), target="bought")[0]


@report("ml_batch_summary")
def _ml_batch_summary(src: Sources) -> DataFrame:
    """What a batch's result says apart from the trained metrics."""
    report_df, run = training_run(src)
    return report_df.agg(F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("tests_passed")).select(
        "tests", "tests_passed", F.lit(run.table.count()).cast("bigint").alias("rows"),
        F.lit(len(run.features)).cast("bigint").alias("features"),
        F.lit(run.leaderboard.count()).cast("bigint").alias("models"))


def _state_of(src: Sources) -> tuple:
    """Identity of a data directory's current files: bytes, files and newest change."""
    sc = src.spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(src.sf_dir)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    total = fs.getContentSummary(path)
    newest = max((f.getModificationTime() for f in fs.listStatus(path)), default=0)
    return (sc.applicationId, src.sf_dir, total.getLength(), total.getFileCount(), newest)


def training_run(src: Sources):
    """One training run per session and data, shared by the ML reports: a data directory
    is known by its path and the state of its files, tables given directly by the
    :class:`Sources` object itself, for as long as it lives.  At most ``RUNS_KEPT``
    directories are held; a run that leaves drops its cached splits."""
    from .daily import run_daily_batch
    held, key = (_GIVEN_RUNS, src) if src.given else (_RUNS, _state_of(src))
    if key not in held:
        while not src.given and len(held) >= RUNS_KEPT:
            held.pop(next(iter(held)))[1].release()
        got = run_daily_batch(src.spark, src, scratch_path(src.spark, f"runs/{uuid.uuid4().hex}"))
        held[key] = got
        if src.given:
            weakref.finalize(src, got[1].release)
    return held[key]


@report("ml_leaderboard")
def _ml_leaderboard(src: Sources) -> DataFrame:
    return training_run(src)[1].leaderboard


@report("ml_champion")
def _ml_champion(src: Sources) -> DataFrame:
    from ..ml import train
    return train.champion(training_run(src)[1].leaderboard)


@report("ml_scores")
def _ml_scores(src: Sources) -> DataFrame:
    from .daily import champion_scores
    return champion_scores(training_run(src)[1])


@report("ml_evaluate")
def _ml_evaluate(src: Sources) -> DataFrame:
    """Evaluate the saved champion on the whole feature table."""
    from ..ml import prepare
    from ..ml.evaluate import evaluate_scores, score
    from ..sources import artifacts
    run = training_run(src)[1]
    model = artifacts.load_model(src.spark, run.out)
    return evaluate_scores(src.spark, score(model, run.table, prepare.TARGET))


@report("ml_shap")
def _ml_shap(src: Sources, n: int | None = None) -> DataFrame:
    """Mean |SHAP| per feature of the best tree model, over all training rows
    (``n`` = seeded sample size, optional)."""
    from ..ml import explain, train
    run = training_run(src)[1]
    board = run.leaderboard.filter(F.col("model").isin(*train.TREE_MODELS))
    best = train.champion(board).first()["model"]
    return explain.shap_importance(src.spark, run.models[best].stages[-1], run.train, run.features, n=n,
                                   partitions=src.spark.sparkContext.defaultParallelism)


@report("ml_metrics_read")
def _ml_metrics_read(src: Sources) -> DataFrame:
    from ..sources import artifacts
    return artifacts.load_metrics(src.spark, training_run(src)[1].out)


@report("ml_daily_run")
def _ml_daily_run(src: Sources) -> DataFrame:
    """One summary row of the batch: tests, champion and its metrics."""
    report_df, run = training_run(src)
    best = run.leaderboard.filter(F.col("model") == run.champion).first()   # 3-row table
    tests = report_df.agg(F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("tests_passed"))
    return tests.select(
        "tests", "tests_passed",
        F.lit(run.champion).alias("champion"), F.lit(best["auc"]).cast("double").alias("auc"),
        F.lit(best["accuracy"]).cast("double").alias("accuracy"), F.lit(best["rows"]).cast("bigint").alias("rows"),
        F.lit(len(run.features)).alias("features"), F.lit(run.importance is not None).alias("explained"),
    )


# Typed scalar parameters: SQL type name -> converter of the JSON value.
PARAM_TYPES = {
    "DATE": lambda v: v if isinstance(v, _dt.date) else _dt.date.fromisoformat(str(v)),
    "TIMESTAMP": lambda v: v if isinstance(v, _dt.datetime) else _dt.datetime.fromisoformat(str(v)),
    "INT64": int,
    "FLOAT64": float,
    "STRING": str,
    "BOOL": lambda v: v if isinstance(v, bool) else str(v).strip().lower() in ("true", "1"),
}


def typed_params(params) -> dict:
    """``{name: value}`` from either a dict or a list of ``{name, type, value}``
    entries; a null value stays None (an open bound)."""
    if params is None:
        return {}
    if isinstance(params, dict):
        return dict(params)
    out = {}
    for p in params:
        kind = str(p.get("type", "STRING")).upper()
        if kind not in PARAM_TYPES:
            raise ValueError(f"unsupported parameter type {kind!r} for {p.get('name')!r}")
        v = p.get("value")
        out[p["name"]] = None if v is None else PARAM_TYPES[kind](v)
    return out


def run_report(spark: SparkSession, name: str | None, source: str | Sources,
               params=None) -> DataFrame:
    """Run a named report with typed parameters over a data directory of the
    driver tables or a :class:`Sources` (e.g. ``Sources.from_tables``).

    A missing name raises ``ValueError``, an unknown one ``KeyError``;
    parameters a report does not take are ignored.
    """
    if not name:
        raise ValueError("report name is required")
    if name not in REGISTRY:
        raise KeyError(f"unknown report {name!r}")
    fn = REGISTRY[name]
    accepted = {k: v for k, v in typed_params(params).items() if k in inspect.signature(fn).parameters}
    src = source if isinstance(source, Sources) else Sources(spark, source)
    return fn(src, **accepted)


def run_sql(spark: SparkSession, text: str, source: str | Sources, params=None) -> DataFrame:
    """Run SQL text over the gold models and the silver tables, with typed named
    parameters (``:name``; null stays null).  The models are session views under
    their report names; only those the text names are computed."""
    src = source if isinstance(source, Sources) else Sources(spark, source)
    views = {name: (lambda make=make: make(src)) for name, make in GOLD_MODELS.items()} | {
        "users": lambda: src.users, "orders": lambda: src.orders, "order_items": lambda: src.items,
        "events": lambda: src.events}
    for name, make in views.items():
        if re.search(rf"\b{name}\b", text, re.IGNORECASE):
            publish(make(), name)
    return spark.sql(text, args=typed_params(params))


from . import experiment_reports, operation_reports, scorer_reports  # noqa: E402,F401  (they register their reports)
