import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from kpiloom.llm import search

from .data import awkward_documents, empty_documents

TERM = re.compile(search.TERM_RE)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, best):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in tf]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in tf for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(tf, sizes):
            score = sum(weight[w] * ((10 ** 9 * c[w]) // (1000 * c[w] + 20 * (100 - 50 + 50 * n * n_docs // total)))
                        for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda f: f[:3])
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(found[:best], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_results_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert rows(search.rank_documents(docs, items)) == want
    # many blocks of items give the same rows
    assert rows(search.rank_documents(docs, items, block_items=30)) == want


def test_awkward_documents_and_items(spark, monkeypatch):
    docs = awkward_documents(spark)
    items = spark.createDataFrame(
        [(1, "The of und", 1), (2, None, 1), (3, " *** ", 1), (4, "ÉTÉ naïve 漢字 été", 1), (None, "x", 1),
         (5, "no such terms here", 1), (1, "The of und", 1), (6, "line tail", 1)], "item_id long, text string, rank int")
    want = brute([(r.doc_id, r.text) for r in docs.collect()],
                 [(1, "The of und"), (4, "ÉTÉ naïve 漢字 été"), (None, "x"), (5, "no such terms here"), (6, "line tail")], 7)
    assert rows(search.rank_documents(docs, items, best=7)) == want
    monkeypatch.setattr(search, "LONG", 50)
    assert rows(search.rank_documents(docs, items, best=7)) == want
    assert rows(search.rank_documents(empty_documents(spark), items)) == []
    assert rows(search.rank_documents(docs, items.where("item_id = 2"))) == []


def test_sharing_adds_the_same_sums_with_fewer_additions():
    rng = random.Random(2)
    common = [sorted(rng.sample(range(60), 8)) for _ in range(6)]
    items = [np.array(sorted({*rng.choice(common), *rng.choice(common), *rng.sample(range(60, 200), 5)}), np.int64)
             for _ in range(50)] + [np.zeros(0, np.int64), np.array([3])]
    plan = search.share(items, 200)
    gains = np.zeros((plan.n_nodes, 9), np.int64)
    gains[:200] = np.random.default_rng(1).integers(0, 1000, (200, 9))
    want = np.array([gains[:200][i].sum(axis=0) if len(i) else np.zeros(9) for i in items])
    assert (plan.item_scores(gains) == want).all()
    assert plan.additions < 0.7 * sum(map(len, items))
    assert search.share([], 0).additions == 0


def test_counts_of_terms():
    vocabulary = ["a1", "été", "b"]
    n, text, term, tf = search.count_terms(pa.array(["A1 b,b", None, "", "Été été\x00ÉTÉ x"]), pa.array(vocabulary))
    assert n.tolist() == [3, 0, 0, 4]
    assert list(zip(text.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 1), (0, 2, 2), (3, 1, 1)]


def test_best_keeps_ties_by_id():
    best = search.Best(1, 3)
    best.room = 4
    rng = np.random.default_rng(4)
    every = []
    for _ in range(30):
        scores, ids = rng.integers(0, 4, (1, 5)), rng.integers(0, 1000, 5)
        every += [(-s, i) for s, i in zip(scores[0].tolist(), ids.tolist()) if s]
        best.add(scores, ids, np.zeros(5, np.int64))
    _, score, ids, _ = best.cut()
    assert list(zip((-score).tolist(), ids.tolist())) == sorted(every)[:3]
