import math
import random

import numpy as np
import pytest

from kpiloom.llm import embeddings

from .data import components


def brute(rows, cosine=0.95):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float64)
        return a / np.linalg.norm(a)
    u = [unit(v) for _, v in rows]
    linked = lambda i, j: u[i] is not None and u[j] is not None and float(u[i] @ u[j]) >= cosine
    label = components(len(rows), linked)
    first = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    out = []
    for k, ((i, _), c) in enumerate(zip(rows, label)):
        n = sum(linked(k, j) for j in range(len(rows)) if j != k)
        out.append((i, n, i if u[k] is None else first.get(c)))
    return sorted(out, key=str)


def brute_by_length(df):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    return sorted((x for n in {len(v) for _, v in rows} for x in brute([r for r in rows if len(r[1]) == n])), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, key string, node string")


def got(df, **how):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_dedup(df, **how).collect()), key=str)


def floats(v):
    return [float(x) for x in np.asarray(v, np.float32)]


@pytest.mark.parametrize("dim,tile", [(2, 4), (16, 8), (64, 256)])
def test_matches_brute_force_with_a_hot_group(spark, dim, tile):
    rng = np.random.default_rng(dim)
    rows = [(i, floats(rng.standard_normal(dim))) for i in range(60)]
    centre = rng.standard_normal(dim)
    rows += [(100 + i, floats(centre + 0.02 * rng.standard_normal(dim))) for i in range(50)]
    rows += [(200 + i, rows[0][1]) for i in range(10)] + [(300, floats(np.array(rows[1][1]) * 7))]
    edge = rng.standard_normal(dim)
    for i, wide in enumerate((0.1, 0.2, 0.3, 0.35)):          # around the threshold
        off = rng.standard_normal(dim)
        off -= (off @ edge) / (edge @ edge) * edge
        off *= np.linalg.norm(edge) / np.linalg.norm(off)
        rows.append((400 + i, floats(edge + wide * off)))
    rows.append((410, floats(edge)))
    df = frame(spark, rows)
    assert got(df, tile=tile) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (None, v), (3, None), (4, [0.0, 0.0, -0.0]), (5, [1.0, None, 2.0]),
            (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [2.0, 4.0, 6.0]),
            (9, [-1.0, -2.0, -3.0]), (10, [1e30, 2e30, 3e30]), (11, [0.0, 1.0, 0.0]), (12, [-0.0, 1.0, -0.0])]
    df = frame(spark, rows)
    assert got(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])
    kept = {r.vec_id: r.kept for r in embeddings.embedding_dedup(df).collect()}
    assert kept[1] and kept[3] and not kept[8] and kept[9] and not kept[12]
    assert got(df.where("false")) == []
    unlike = frame(spark, [(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0]), (4, [2.0, 0.1]), (5, [1.0, 0.0, 0.0]), (6, [-3.0])])
    assert got(unlike) == brute_by_length(unlike)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    dim, n = 64, 20000
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal((n, dim))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * off
    lines = embeddings.directions(dim)
    half = embeddings.half_window(dim, 0.95, embeddings.WINDOW)
    hits = (np.abs((a - b) @ lines.T) <= half)
    counted = hits.sum(axis=1) >= embeddings.calibrated_count(len(lines))
    for axes in (1, 3, embeddings.MOST_ROUTING):            # cells on these, windows on one more
        assert (counted & hits[:, :axes + 1].all(axis=1)).mean() > 0.994


def test_many_vectors_take_more_axes(spark):
    assert [embeddings.routing_axes(n) for n in (0, 100, 50_000, 10 ** 7, 10 ** 12)] == [1, 1, 2, 5, 8]
    rng = np.random.default_rng(9)
    rows = [(i, floats(rng.standard_normal(5))) for i in range(120)]
    df = frame(spark, rows + [(200, floats(rng.standard_normal(2))), (201, floats(rng.standard_normal(2)))])
    want = brute_by_length(df)
    for axes in (1, 2, 4):
        assert got(df, routing=axes, tile=8) == want


def test_windows_lose_no_pair():
    rng = np.random.default_rng(6)
    a, b = (embeddings.unit_rows(rng.standard_normal((n, 4))) for n in (90, 70))
    lines = embeddings.directions(4)
    half, count = embeddings.half_window(4, 0.95, embeddings.WINDOW), embeddings.calibrated_count(len(lines))
    a, b = (x[np.argsort(x @ lines[1])] for x in (a, b))
    for same, y in ((False, b), (True, a)):
        want = embeddings.near_pairs(a, y, lines @ a.T, lines @ y.T, same, 9.0, 0, 0.95)
        have = embeddings.windowed_pairs(a, y, lines @ a.T, lines @ y.T, same, 1, half, count, 0.95)
        kept = [(i, j) for i, j in zip(*want) if (np.abs(lines @ (a[i] - y[j])) <= half).sum() >= count
                and abs(lines[1] @ (a[i] - y[j])) <= half]
        assert set(kept) <= set(zip(*have)) <= set(zip(*want)) and len(kept) > 10


def test_calibration():
    assert embeddings.calibrated_count(24) in (22, 23)
    assert embeddings.calibrated_count(10, window=0.1, recall=0.9) == 0
    counts = [embeddings.calibrated_count(20, recall=r) for r in (0.5, 0.99, 0.999999)]
    assert counts == sorted(counts, reverse=True)


def test_sf_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = {r[0]: r for r in brute([(r.vec_id, r.embedding) for r in df.collect()])}
    have = {r[0]: r for r in got(df)}
    assert sum(have[i][1] for i in want) >= 0.99 * sum(r[1] for r in want.values())
    assert random.Random(0).sample(sorted(want), 5)
