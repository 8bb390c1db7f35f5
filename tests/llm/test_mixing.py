import re

import pytest
from pyspark.sql import functions as F

from kpiloom.llm import mixing

from .data import awkward_documents, empty_documents


def brute_targets(sizes):
    """Share by weight, cap at three times the size, reshare the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 3.0 * sizes[s] for s in over}


def sizes_of(docs):
    out = {}
    for r in docs.collect():
        out[r.source] = out.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    return out


def check(docs, block=4):
    sizes = sizes_of(docs)
    target = brute_targets(sizes)
    joined = mixing.mix_counts(docs.withColumn("doc_id", F.struct("doc_id", "source", "text")), block=block)
    taken = {}
    for r in joined.collect():
        s = r.doc_id.source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.doc_id.text or ""))
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        assert sum(r.shard_words.values()) == r.taken and set(r.shard_words) <= set(range(8))
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * block, s
    return joined.count()


def test_awkward_documents(spark):
    docs = awkward_documents(spark)
    assert check(docs) == docs.count()


def test_capped_sources_and_a_hot_one(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else "a") for i in range(600)]
    rows += [(900, "only words", "0"), (901, "", "zero"), (902, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert check(docs) == len(rows)


def test_small_sources_meet_their_targets(spark):
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.format_string("s%03d", (F.col("id") / 2).cast("int")).alias("source"),
        F.repeat(F.lit("w "), 20).alias("text"))
    sources = mixing.mix_counts(docs.withColumn("doc_id", F.col("source"))).groupBy("doc_id").agg(
        F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(sources) == 300
    assert {round(r.target) for r in sources} == {75, 30, 15}
    assert all(abs(r.taken - r.target) <= 4 for r in sources)
    assert abs(sum(r.taken - r.target for r in sources)) <= 0.01 * 300 * 40
    mixed = mixing.mix_documents(docs)
    assert mixed.select("source").distinct().count() == 300


def test_targets_under_a_word_are_met_on_average(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("s%04d", "id").alias("source"),
                                    F.lit("word").alias("text"))
    got = mixing.mix_counts(docs).groupBy(F.round("target", 3).alias("t")).agg(F.avg("taken").alias("a")).collect()
    assert len(got) == 3 and all(abs(r.a - r.t) < 0.06 for r in got)


def test_reruns_agree(spark):
    docs = awkward_documents(spark)
    runs = [sorted(map(str, mixing.mix_counts(d).collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]


def test_mixed_texts_hold_the_taken_words(spark):
    docs = awkward_documents(spark).dropDuplicates(["doc_id"]).where("doc_id is not null")
    want = {r.doc_id: r.taken for r in mixing.mix_counts(docs, block=8).collect()}
    mixed = mixing.mix_documents(docs, block=8)
    assert mixed.columns == docs.columns
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = dict.fromkeys(want, 0)
    for r in mixed.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        own = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        at = iter(own)
        assert all(w in at for w in words)              # in order
        assert len(words) < len(own) or r.text == texts[r.doc_id]
        assert "\n" not in r.text or "\n" in texts[r.doc_id]
        assert r.n_chars == len(r.text)
        got[r.doc_id] += len(words)
    assert got == want


def test_partly_drawn_texts_keep_their_lines(spark):
    lines = "\n".join(f"{i}a  {i}b\t{i}c" for i in range(40))
    docs = spark.createDataFrame([(i, lines, "abc"[i % 3]) for i in range(12)], "doc_id long, text string, source string")
    parts = [r.text for r in mixing.mix_documents(docs, block=16).collect()]
    assert any(t != lines for t in parts)
    for t in parts:
        own = re.findall(r"\s*\S+", lines)
        at = 0
        for i, w in enumerate(re.findall(r"\s*\S+", t)):
            at = next(k for k in range(at, len(own)) if own[k].strip() == w.strip()) + 1
            assert i == 0 or w == own[at - 1]           # with the white space it had
        assert t == t.lstrip()


def test_shards_draw_their_source_counts(spark):
    """The counts are multinomial: their chi-square against equal shares is that of chance,
    they differ from seed to seed, and they decide which words a shard holds."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 50).alias("text"),
                                   F.format_string("s%02d", F.col("id") % 40).alias("source"))
    _, sources, pieces = mixing.mix(docs, block=8)
    counts = {}
    for seed in range(6):
        rows = mixing.draw_shards(sources, seed, 8).collect()
        for r in rows:
            counts.setdefault((seed, r["rank"]), {})[r.out_shard] = r.n
            assert r.before == sum(q.n for q in rows if q["rank"] == r["rank"] and q.out_shard < r.out_shard)
    chi = []
    for c in counts.values():
        n = sum(c.values())
        chi.append(sum((c.get(k, 0) - n / 8) ** 2 / (n / 8) for k in range(8)))
    assert 6.2 < sum(chi) / len(chi) < 7.8              # 7 degrees of freedom, 240 draws
    assert len({tuple(sorted(c.items())) for c in counts.values()}) > 200
    drawn = {(r["rank"], r.out_shard): r.n for r in mixing.draw_shards(sources, 7, 8).collect()}
    held = {(r["rank"], r.out_shard): r.n for r in pieces.select("rank", "out_shard", "slot").distinct().groupBy(
        "rank", "out_shard").agg(F.count("*").alias("n")).collect()}
    assert held == drawn


def test_empty_table(spark):
    assert mixing.mix_counts(empty_documents(spark)).count() == 0
    assert mixing.mix_documents(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_one_to_one(spark, n):
    df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(3)]).alias("p"))
    got = [(r.id, r.p) for r in df.collect()]
    assert sorted(p for _, p in got) == list(range(n))
    assert n < 100 or sum(i == p for i, p in got) < n / 10


def test_many_sources_are_ranked_in_ranges(spark):
    df = spark.range(300).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(5).cast("long").alias("source_size"))
    df = df.union(spark.createDataFrame([(None, 5)], "source string, source_size long"))
    got = {r.source: r["rank"] for r in mixing._wide_rank(df).collect()}
    want = sorted((s for s in got if s is not None), key=str.encode)
    assert [got[s] for s in want] == list(range(300)) and got[None] == 300


def test_plan_is_native(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixing.mix_counts(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
