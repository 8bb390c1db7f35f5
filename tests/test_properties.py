"""Properties of the gold models on the driver's smallest tables."""

import pytest
from pyspark.sql import functions as F

from kpiloom.ml.evaluate import auc
from kpiloom.operators import assignment as asg
from kpiloom.operators import features as feat
from kpiloom.operators import retention as ret
from kpiloom.sources.silver import Sources

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def src(spark):
    return Sources(spark, SF_SMALL)


def test_assignment_stable_under_repartition(src):
    a = {r["user_id"]: r["ab_group"] for r in asg.ab_group(src.users).collect()}
    b = {r["user_id"]: r["ab_group"] for r in asg.ab_group(src.users.repartition(7, "id")).collect()}
    assert a == b
    share_a = sum(1 for g in a.values() if g == "A") / len(a)
    assert 0.35 < share_a < 0.65


def test_retention_at_most_one(src):
    r = ret.retention_weekly(src.users, src.events)
    assert r.filter((F.col("retention_rate") > 1) | (F.col("retention_rate") <= 0)).count() == 0
    assert r.filter(~F.col("week_n").between(0, 12)).count() == 0


def test_shares_sum_at_most_one(src):
    f = feat.features_conversion(src.users, src.orders, src.items, src.events)
    total = sum(F.col(c) for c in feat.SOURCES)
    assert f.filter(total > 1 + 1e-12).count() == 0
    assert f.filter(~F.col("will_convert_14d").isin(0, 1)).count() == 0


def test_label_counts_match_fixture(src):
    f = feat.features_conversion(src.users, src.orders, src.items, src.events)
    counts = {r["will_convert_14d"]: r["count"] for r in f.groupBy("will_convert_14d").count().collect()}
    assert counts == {1: 11, 0: 4}


def test_results_do_not_depend_on_session_zone(spark):
    def run():
        s = Sources(spark, SF_SMALL)
        f = feat.features_conversion(s.users, s.orders, s.items, s.events)
        r = ret.retention_weekly(s.users, s.events)
        return sorted(map(tuple, f.collect())), sorted(map(tuple, r.collect()))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        a = run()
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        b = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert a == b


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_equals_pairwise_count(spark):
    import random
    rng = random.Random(3)
    pairs = [(float(rng.randint(0, 9)), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "score double, label int")
    assert auc(df) == pytest.approx(brute_auc(pairs), abs=1e-12)
