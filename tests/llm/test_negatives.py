import math

import numpy as np

from kpiloom.llm import negatives

CLASH = "a long, bound long, score long, v string, part int"
SCHEMA = f"vec_id long, embedding array<double>, label int, {CLASH}"
EXTRA = (0, 0, 0, "v", 0)


def usable(row):
    i, v, label = row[:3]
    return (i is not None and label is not None and v and all(
        x is not None and math.isfinite(x) and abs(x) < negatives.LARGEST for x in v))


def brute(rows, modulus=100, n_pos=5, n_neg=5):
    part = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in filter(usable, rows)]
    anchors = {(i, tuple(v), label) for i, v, label in part if i % modulus == 0}
    out = []
    for i, v, label in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, own) for j, w, own in part if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for p, j, _ in [s for s in scored if s[2] == label][:n_pos]:
            near = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:n_neg]
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(df, **how).collect())


def clustered(n, dim, seed, lengths=(1.0,)):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))
    x = x / np.linalg.norm(x, axis=1)[:, None] * rng.choice(lengths, n)[:, None]
    return [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(x.tolist())]


def test_results_equal_brute_force(spark):
    rows = clustered(700, 16, 1)
    assert mined(spark, rows, anchor_modulus=20) == brute(rows, 20)
    # small tiles, blocks of a few anchors and vectors of very unlike lengths
    rows = clustered(500, 8, 2, lengths=(0.01, 0.3, 1.0, 40.0))
    assert mined(spark, rows, anchor_modulus=10, tile=16, block=7, focus=3) == brute(rows, 10)


def test_awkward_vectors(spark):
    near = [(i, [1.0, 0.01 * i, 0.0], i % 3) for i in range(1, 60)]
    rows = near + [
        (0, [1.0, 0.2, 0.1], 0), (100, [0.0, 0.0, 0.0], 1), (200, [-1.0, -0.2, 0.3], 2), (300, [1.0, 0.2], 0),
        (400, [1.0, 0.3], 0), (500, [1.0, 0.25], 1), (None, [1.0, 0.2, 0.1], 0), (600, None, 0), (700, [1.0, 0.2, 0.1], None),
        (800, [], 0), (900, [1.0, None, 0.0], 0), (61, [float("nan"), 1.0, 0.0], 1), (62, [float("inf"), 1.0, 0.0], 1),
        (63, [1e30, 0.0, 0.0], 1), (0, [1.0, 0.2, 0.1], 0), (5, [1.0, 0.05, 0.0], 2), (5, [1.0, 0.05, 0.0], 2)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 20
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_one_label_and_equal_vectors(spark):
    """A third of all rows one vector: copies split over tiles, ties go by id."""
    rows = [(i, [0.6, 0.8] if i % 3 else [0.8, 0.6], i % 2) for i in range(300)]
    assert mined(spark, rows, tile=8) == brute(rows)


def test_coordinates_lose_no_row_and_prune():
    rng = np.random.default_rng(3)
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in clustered(2000, 16, 4, lengths=(1.0, 1.05))])
    order = np.argsort(negatives.unit(x)[0], axis=0, kind="stable").T.astype("<i4").tobytes()
    tile = negatives.Tile(16, np.arange(2000).astype("<i8").tobytes(), x.astype("<i4").tobytes(), order)
    left = []
    for i in rng.integers(0, 2000, 50):
        (q,), (length,) = negatives.unit(x[i][None, :])
        scores = x @ x[i]
        for cosine in (-0.5, 0.0, 0.5, 0.9, 0.99):
            low = int(cosine * length * length)
            rows = tile.candidates(q, length, low, 4)
            rows = np.arange(2000) if rows is None else rows
            assert set(np.flatnonzero(scores >= low)) <= set(rows.tolist())
            if cosine == 0.9:
                left.append(len(rows) / 2000)
    assert np.mean(left) < 0.5
