"""Calendar functions against Python's date arithmetic on random values."""

import datetime as dt
import random


from kpiloom.functions.dates import day_start, full_days_between, week_start, weeks_between


def test_calendar_functions(spark):
    rng = random.Random(9)
    base = dt.datetime(1999, 12, 25)
    rows = []
    for _ in range(500):
        a = base + dt.timedelta(seconds=rng.randint(0, 40 * 365 * 86400), microseconds=rng.randint(0, 999999))
        b = base + dt.timedelta(seconds=rng.randint(0, 40 * 365 * 86400))
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select("a", "b", week_start("a").alias("mon"), week_start("a", "sunday").alias("sun"),
                    full_days_between("a", "b").alias("days"), day_start("a").alias("midnight"),
                    weeks_between(week_start("a"), week_start("b")).alias("weeks")).collect()
    for r in out:
        a, b = r["a"], r["b"]
        assert r["mon"] == a.date() - dt.timedelta(days=a.weekday())
        assert r["sun"] == a.date() - dt.timedelta(days=(a.weekday() + 1) % 7)
        diff = a - b
        whole = int(diff.total_seconds() // 86400) if diff >= dt.timedelta(0) else -int((-diff).total_seconds() // 86400)
        assert r["days"] == whole
        assert r["midnight"] == dt.datetime(a.year, a.month, a.day)
        wa = a.date() - dt.timedelta(days=a.weekday())
        wb = b.date() - dt.timedelta(days=b.weekday())
        assert r["weeks"] == (wa - wb).days // 7
