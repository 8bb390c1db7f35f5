"""TreeSHAP against brute-force Shapley values on small trees (no Spark)."""

import itertools
import math
import random

import numpy as np

from kpiloom.ml.explain import _leaf_table, tree_shap


def random_tree(rng, n_features, depth):
    """nodes: id -> (left, right, feature, threshold, cover, value)."""
    nodes = {}
    counter = itertools.count()

    def build(d, cover):
        nid = next(counter)
        if d == 0 or cover < 2 or rng.random() < 0.2:
            nodes[nid] = (-1, -1, -1, 0.0, cover, rng.uniform(-1, 1))
            return nid
        left_cover = rng.randint(1, cover - 1)
        f = rng.randrange(n_features)
        thr = rng.uniform(0, 1)
        nodes[nid] = None
        left = build(d - 1, left_cover)
        right = build(d - 1, cover - left_cover)
        nodes[nid] = (left, right, f, thr, float(cover), 0.0)
        return nid

    build(depth, 100)
    return nodes


def cond_value(nodes, x, subset, nid=0):
    left, right, f, thr, cover, value = nodes[nid]
    if left < 0:
        return value
    if f in subset:
        return cond_value(nodes, x, subset, left if x[f] <= thr else right)
    return (nodes[left][4] * cond_value(nodes, x, subset, left)
            + nodes[right][4] * cond_value(nodes, x, subset, right)) / cover


def brute_shap(nodes, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[i] += w * (cond_value(nodes, x, set(s) | {i}) - cond_value(nodes, x, set(s)))
    return phi


def test_tree_shap_matches_brute_force():
    rng = random.Random(7)
    m = 4
    for trial in range(25):
        trees = [random_tree(rng, m, rng.randint(1, 5)) for _ in range(3)]
        scales = [0.5, 1.0, 0.25]
        tables = [_leaf_table(t, s) for t, s in zip(trees, scales)]
        x = np.array([[rng.random() for _ in range(m)] for _ in range(6)])
        phi, base = tree_shap(tables, x, m)
        for r in range(x.shape[0]):
            expect = sum(s * brute_shap(t, x[r], m) for t, s in zip(trees, scales))
            assert np.allclose(phi[r], expect, atol=1e-10), (trial, r, phi[r], expect)
            full = sum(s * cond_value(t, x[r], set(range(m))) for t, s in zip(trees, scales))
            assert abs(phi[r].sum() + base - full) < 1e-10


def test_repeated_feature_on_path():
    # the same feature split twice on one path: one player with an interval
    nodes = {
        0: (1, 4, 0, 0.5, 10.0, 0.0),
        1: (2, 3, 0, 0.2, 6.0, 0.0),
        2: (-1, -1, -1, 0.0, 2.0, 1.0),
        3: (-1, -1, -1, 0.0, 4.0, 3.0),
        4: (5, 6, 1, 0.7, 4.0, 0.0),
        5: (-1, -1, -1, 0.0, 1.0, -2.0),
        6: (-1, -1, -1, 0.0, 3.0, 5.0),
    }
    t = _leaf_table(nodes, 1.0)
    for x in ([0.1, 0.9], [0.3, 0.1], [0.8, 0.6], [0.8, 0.75]):
        phi, base = tree_shap([t], np.array([x]), 2)
        assert np.allclose(phi[0], brute_shap(nodes, x, 2), atol=1e-12)


def test_row_chunking_does_not_change_values(monkeypatch):
    import kpiloom.ml.explain as ex
    rng = random.Random(11)
    trees = [random_tree(rng, 4, 5) for _ in range(2)]
    tables = [_leaf_table(t, 1.0) for t in trees]
    x = np.array([[rng.random() for _ in range(4)] for _ in range(40)])
    whole, base = tree_shap(tables, x, 4)
    monkeypatch.setattr(ex, "MAX_CELLS", 7)
    chunked, base2 = tree_shap(tables, x, 4)
    assert np.allclose(whole, chunked, atol=1e-13) and base == base2
