"""A user holding a third of all events and orders: AQE splits the skewed join
partition and the results do not change."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import features as feat
from kpiloom.operators import funnel as fun
from kpiloom.sources import schemas


@pytest.fixture(scope="module")
def skewed(spark):
    base = dt.datetime(2024, 1, 1)
    n_users = 600
    users = [(u, base - dt.timedelta(days=u % 50)) for u in range(n_users)]
    events, orders, items = [], [], []
    for k in range(6000):
        u = 7 if k % 3 == 0 else k % n_users               # user 7 owns a third of the events
        events.append((u, "page_view" if k % 4 else "add_to_cart", "view",
                       base + dt.timedelta(hours=k % 700), ["Email", "Ads", "Other"][k % 3]))
    for o in range(6000):
        u = 7 if o % 3 == 0 else o % n_users                # and a third of the orders
        orders.append((o, u, "Complete" if o % 2 else "Returned", base + dt.timedelta(hours=(o * 7) % 900)))
        items.extend((o, float(1 + (o + j) % 50)) for j in range(o % 3))
    return (spark.createDataFrame(users, schemas.USERS),
            spark.createDataFrame(orders, schemas.SILVER_ORDERS),
            spark.createDataFrame(items, schemas.ORDER_ITEMS),
            spark.createDataFrame(events, schemas.SILVER_EVENTS))


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_skewed_user_same_results(spark, skewed):
    u, o, i, e = skewed

    def run():
        df = feat.features_conversion(u, o, i, e)
        rows = sorted(map(tuple, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
        return rows, plan

    plain, plain_plan = _with_conf(spark, {"spark.kpiloom.hotKeyRows": "100000000"}, run)
    split, plan = _with_conf(spark, {**SKEW_CONF, "spark.kpiloom.hotKeyRows": "300"}, run)
    assert plain == split
    hot = [r for r in split if r[0] == 7][0]
    assert hot[2] > 1000                            # its item rows all counted


def test_hot_keys_are_salted(spark, skewed):
    from kpiloom.operators.skew import hot_keys, salted_key_join
    u, o, i, e = skewed
    hot = {r["user_id"]: r["_salts"] for r in hot_keys(o, "user_id", 300).collect()}
    assert hot == {7: 7}                            # 2000 orders / 300 per task
    anchors = e.groupBy("user_id").agg(F.max("created_at").alias("anchor_ts"))
    j = salted_key_join(o, anchors, "user_id", counts_from=o, limit=300)
    per_task = _with_conf(spark, SKEW_CONF, lambda: (
        j.filter(F.col("user_id") == 7).withColumn("p", F.spark_partition_id())
        .groupBy("p").count().agg(F.max("count")).first()[0]))
    assert j.count() == o.filter(F.col("user_id").isNotNull()).join(anchors, "user_id").count()
    assert per_task < 2000


def test_skewed_funnel(spark, skewed):
    u, o, i, e = skewed
    a = sorted(map(tuple, fun.funnel_users(u, e, o).collect()))
    b = _with_conf(spark, SKEW_CONF, lambda: sorted(map(tuple, fun.funnel_users(u, e, o).collect())))
    assert a == b and len(a) == 600
