import zlib
from collections import Counter

from pyspark.sql import functions as F

from kpiloom.llm import sharding

from .data import awkward_documents, empty_documents


def check(rows, shards, tolerance):
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    largest = max(Counter((r.doc_id, r.text) for r in rows).values())
    row = max(r.size for r in rows)
    for s in range(shards):
        size = sum(r.size for r in by.get(s, []))
        assert abs(size - total / shards) <= 2 * (tolerance * total / shards + row * largest)


def test_even_bytes_with_a_hot_group(spark):
    rows = [(i, "copy of one hot text") for i in range(400)] + [(1000 + i, "t" * (i % 50)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.histogram_shard(df, 8).collect()
    assert len(got) == len(rows)
    check(got, 8, 0.002)
    again = sharding.histogram_shard(df.repartition(3), 8).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_equal_texts_stay_together_unless_a_target_cuts_them(spark):
    rows = [(i, f"text number {i % 300} of some length") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.histogram_shard(df, 4, tolerance=0.02).collect()
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 3
    check(got, 4, 0.02)


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    got = sharding.histogram_shard(docs, 3).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id and r.text) == sorted(
        (r.doc_id, r.text) for r in docs.collect() if r.doc_id and r.text)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got)
    check(got, 3, 0.002)
    assert sharding.histogram_shard(empty_documents(spark), 8).count() == 0
    one = docs.limit(1)
    assert [(r.slot, r.size) for r in sharding.histogram_shard(one, 8).collect()] == [(0, 1)]


def test_identical_rows_and_more_shards_than_rows(spark):
    df = spark.createDataFrame([(1, "same")] * 40 + [(2, "b")], "doc_id long, text string")
    got = sharding.histogram_shard(df, 8).collect()
    assert len(got) == 41 and len({r.shard for r in got if r.doc_id == 1}) == 1
    check(got, 8, 0.002)


def test_splitters_count_exact_bytes(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"), F.xxhash64("id", "id").alias("t"),
                                    (F.col("id") % 97 + 1).alias("size"))
    rows = [(r.h, r.t, r.size) for r in keys.collect()]
    for s in sharding.find_splitters(keys, 5, 0.001):
        assert s.below == sum(n for h, t, n in rows if (h, t) < (s.h, s.t))


def test_crc_is_unsigned(spark):
    got = spark.sql("select crc32(cast('é' as binary))").first()[0]
    assert got == zlib.crc32("é".encode())
