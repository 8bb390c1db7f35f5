"""Exact path-dependent TreeSHAP for MLlib tree ensembles, run on executors.

Method (Lundberg et al., "Consistent individualized feature attribution for
tree ensembles", 2018): the value of a coalition S is the tree's output when
features in S follow the row and the others split by training cover.  For one
leaf, with the unique features P on its path, that value is a product over P
of ``o_j`` (the row satisfies the path's interval on feature j) when j in S and
``z_j`` (the cover fraction the path keeps on feature j) otherwise.  Shapley
values of such a product game have a closed form through the coefficients of
``prod_j (z_j + o_j t)``; evaluating it per leaf, vectorised over a batch of rows
with numpy, gives exact SHAP values in O(leaves * depth^2) per row.  Leaf
contributions add up over trees, so the leaves of all trees are merged into one
table per path length (tree weight folded into the leaf value).

The model (leaf tables, bounded by the model size, which already lives on the
driver) is read back from the saved model's node data and broadcast; rows are
explained batch by batch in ``mapInPandas``, and the per-feature mean |SHAP| is
a Spark aggregate.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .forest import ForestModel
from .prepare import SEED

SHAP_BATCH = 256


@dataclass
class LeafGroup:
    """Leaves of one tree whose paths have the same number ``d`` of distinct features."""
    value: np.ndarray      # (L,)
    feat: np.ndarray       # (L, d) feature index per path feature
    lo: np.ndarray         # (L, d) the path keeps lo < x <= hi on that feature
    hi: np.ndarray         # (L, d)
    z: np.ndarray          # (L, d) cover fraction the path keeps on that feature
    weight: np.ndarray     # (d,) Shapley weights 1 / (d * C(d-1, k))


@dataclass
class LeafTable:
    groups: list           # [LeafGroup]
    scale: float           # tree weight in the ensemble output
    expected: float        # cover-weighted mean output of the tree


def _leaf_table(nodes: dict, scale: float, path: dict | None = None) -> LeafTable:
    """nodes: id -> (left, right, feature, threshold, cover, value).  ``path``: of a subtree, what
    the way to it keeps, feature -> (low, high, cover fraction)."""
    leaves = []
    stack = [(0, dict(path or {}))]
    while stack:
        nid, cons = stack.pop()
        left, right, f, thr, cover, value = nodes[nid]
        if left < 0:
            leaves.append((value, cons))
            continue
        cl = nodes[left][4] / cover if cover > 0 else 0.5
        cr = nodes[right][4] / cover if cover > 0 else 0.5
        lo, hi, z = cons.get(f, (-math.inf, math.inf, 1.0))
        lcons = dict(cons)
        lcons[f] = (lo, min(hi, thr), z * cl)          # left: x <= threshold
        rcons = dict(cons)
        rcons[f] = (max(lo, thr), hi, z * cr)          # right: x > threshold
        stack.append((left, lcons))
        stack.append((right, rcons))
    expected = 0.0
    by_depth: dict[int, list] = {}
    for value, cons in leaves:
        expected += value * math.prod(c[2] for c in cons.values())
        by_depth.setdefault(len(cons), []).append((value, sorted(cons.items())))
    groups = []
    for d, items in sorted(by_depth.items()):
        if d == 0:
            continue                                   # a single-leaf tree only shifts the base
        value = np.array([v for v, _ in items], dtype=float)
        feat = np.array([[f for f, _ in c] for _, c in items], dtype=np.int64)
        lo = np.array([[b[0] for _, b in c] for _, c in items], dtype=float)
        hi = np.array([[b[1] for _, b in c] for _, c in items], dtype=float)
        z = np.array([[b[2] for _, b in c] for _, c in items], dtype=float)
        weight = np.array([1.0 / (d * math.comb(d - 1, k)) for k in range(d)])
        groups.append(LeafGroup(value, feat, lo, hi, z, weight))
    return LeafTable(groups, scale, expected)


MAX_CELLS = 100_000        # rows x leaves x (depth + 1) per working array (800 KB)
ROW_CHUNK = 64


def _group_shap(g: LeafGroup, x: np.ndarray, phi: np.ndarray, scale: float) -> None:
    """Add one leaf group's contributions to ``phi``.  Leaves and rows are taken in
    chunks, so every working array stays near ``MAX_CELLS`` doubles whatever the
    number and depth of the trees."""
    n_leaves, d = g.feat.shape
    leaves = max(1, MAX_CELLS // (min(ROW_CHUNK, max(1, x.shape[0])) * (d + 1)))
    for at in range(0, n_leaves, leaves):
        part = LeafGroup(value=g.value[at:at + leaves], feat=g.feat[at:at + leaves], lo=g.lo[at:at + leaves],
                         hi=g.hi[at:at + leaves], z=g.z[at:at + leaves], weight=g.weight)
        size = len(part.value)
        # leaf -> feature scatter matrices, one per path position
        onehots = []
        for i in range(d):
            oh = np.zeros((size, phi.shape[1]))
            oh[np.arange(size), part.feat[:, i]] = 1.0
            onehots.append(oh)
        step = max(1, MAX_CELLS // (size * (d + 1)))
        for start in range(0, x.shape[0], step):
            _group_shap_rows(part, x[start:start + step], phi[start:start + step], scale, onehots)


def _group_shap_rows(g: LeafGroup, x: np.ndarray, phi: np.ndarray, scale: float, onehots) -> None:
    n = x.shape[0]
    n_leaves, d = g.feat.shape
    xv = x[:, g.feat]                                            # (n, L, d)
    # as the fitted trees decide: left when x <= threshold, else right (NaN goes right);
    # an infinite bound stands for no split on that side
    right = ~(xv <= g.lo) | np.isneginf(g.lo)
    left = (xv <= g.hi) | np.isposinf(g.hi)
    o = (right & left).astype(float)
    z = g.z
    # Q(t) = prod_j (z_j + o_j t): coefficients along the last axis
    q = np.zeros((n, n_leaves, d + 1))
    q[..., 0] = 1.0
    for j in range(d):
        nq = q * z[:, j][None, :, None]
        nq[..., 1:] += q[..., :-1] * o[..., j][..., None]
        q = nq
    r_div = np.empty((n, n_leaves, d))
    for i in range(d):
        zi = z[:, i][None, :]
        oi = o[..., i]
        # Q / (z_i + o_i t): a constant divisor when o_i = 0, synthetic division when o_i = 1
        r_div[..., d - 1] = q[..., d]
        for k in range(d - 1, 0, -1):
            r_div[..., k - 1] = q[..., k] - zi * r_div[..., k]
        s_div = r_div @ g.weight                                 # (n, L)
        s_const = (q[..., :d] @ g.weight) / zi
        s = np.where(oi > 0, s_div, s_const)
        contrib = g.value[None, :] * (oi - zi) * s               # (n, L)
        phi += scale * (contrib @ onehots[i])


def merge_tables(tables: list[LeafTable]) -> LeafTable:
    """All trees' leaves in one table: contributions add up over trees and each
    depends only on its own path, so leaves of equal path length from every tree
    form one group (tree weight folded into the leaf value).  Fewer, larger
    array operations per batch."""
    by_depth: dict[int, list] = {}
    for t in tables:
        for g in t.groups:
            by_depth.setdefault(g.feat.shape[1], []).append((g, t.scale))
    groups = []
    for d, parts in sorted(by_depth.items()):
        groups.append(LeafGroup(
            value=np.concatenate([g.value * sc for g, sc in parts]),
            feat=np.concatenate([g.feat for g, _ in parts]),
            lo=np.concatenate([g.lo for g, _ in parts]),
            hi=np.concatenate([g.hi for g, _ in parts]),
            z=np.concatenate([g.z for g, _ in parts]),
            weight=parts[0][0].weight))
    return LeafTable(groups, 1.0, float(sum(t.scale * t.expected for t in tables)))


def tree_shap(tables, x: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """SHAP values (rows, features) of the ensemble output and its expected value.
    ``tables``: the per-tree leaf tables or one merged table."""
    merged = tables if isinstance(tables, LeafTable) else merge_tables(tables)
    phi = np.zeros((x.shape[0], n_features))
    for g in merged.groups:
        _group_shap(g, x, phi, merged.scale)
    return phi, merged.scale * merged.expected


def _nodes_from_saved(spark: SparkSession, path: str, classification: bool):
    """Read a saved tree ensemble's node table; one dict of nodes per tree.

    Cover (training weight at the node), leaf value and threshold are computed
    in Spark, and only those numeric columns come to the driver (through Arrow):
    the table is the size of the model, which the driver holds already.
    """
    nd = spark.read.parquet(os.path.join(path, "data"))
    stats = F.col("nodeData.impurityStats")
    if classification:
        cover = F.aggregate(stats, F.lit(0.0), lambda acc, v: acc + v)
        value = F.when(cover > 0, F.try_element_at(stats, F.lit(2)) / cover).otherwise(F.lit(0.0))
    else:
        cover = F.try_element_at(stats, F.lit(1))
        value = F.col("nodeData.prediction")
    cols = nd.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.coalesce(F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)),
                   F.lit(0.0)).alias("threshold"),
        F.coalesce(cover, F.lit(0.0)).alias("cover"), F.coalesce(value, F.lit(0.0)).alias("value"),
    ).toPandas()
    trees: dict[int, dict] = {}
    for t, left, right, f, thr, cov, val, nid in zip(
            cols["tree"].to_numpy(), cols["left"].to_numpy(), cols["right"].to_numpy(),
            cols["feature"].to_numpy(), cols["threshold"].to_numpy(), cols["cover"].to_numpy(),
            cols["value"].to_numpy(), cols["id"].to_numpy()):
        trees.setdefault(int(t), {})[int(nid)] = (int(left), int(right), int(f), float(thr), float(cov), float(val))
    return trees


def leaf_tables(spark: SparkSession, tree_model) -> list[LeafTable]:
    """Leaf tables of a fitted random forest (probability of class 1, mean over
    trees), gradient-boosted classifier (margin, tree-weighted sum) or second-order
    boosted model (margin over its base)."""
    name = type(tree_model).__name__
    if name == "BoostedModel":
        return [_leaf_table(nodes, 1.0) for nodes in tree_model.nodes()]
    path = scratch_path(spark, f"shap-models/{tree_model.uid}")
    tree_model.write().overwrite().save(path)
    if name == "RandomForestClassificationModel":
        trees = _nodes_from_saved(spark, path, classification=True)
        scales = {t: 1.0 / len(trees) for t in trees}
    elif name == "GBTClassificationModel":
        trees = _nodes_from_saved(spark, path, classification=False)
        w = list(tree_model.treeWeights)
        scales = {t: w[t] for t in trees}
    else:
        raise TypeError(f"TreeSHAP needs a tree ensemble, got {name}")
    return [_leaf_table(trees[t], scales[t]) for t in sorted(trees)]


def _forest_values(model: ForestModel, rows: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """:func:`shap_values` of a forest that lies in parts: each is explained where it is read."""
    cuts, m, scale = model.cuts, len(features), 1.0 / model.how.trees

    def table(place, nodes) -> LeafTable:
        def bound(f, b):
            return -math.inf if b < 0 else float(cuts[f][b]) if b < len(cuts[f]) else math.inf
        path = {f: (bound(f, int(lo)), bound(f, int(hi)), float(z)) for f, (lo, hi, z) in enumerate(
            zip(place["low"], place["high"], place["share"])) if lo >= 0 or hi <= len(cuts[f])}
        share = nodes.ones / nodes.rows.astype(float)
        return _leaf_table({i: (int(k), int(k) + 1, int(f), bound(f, int(b)), float(n), float(v)) for i, (k, f, b, n, v)
                            in enumerate(zip(nodes.left, nodes.feature, nodes.bin, nodes.rows, share))}, scale, path)

    def values(place, nodes, bins, x):
        phi, base = tree_shap([table(place, nodes)], x, m)
        return np.column_stack([np.full(len(x), base), phi])

    names = ["base", *(f"shap_{f}" for f in features)]
    return model.with_sums(rows, names, values, whole=True).select(F.col(id_col).cast("long").alias(id_col), *names)


def shap_values(spark: SparkSession, tree_model, df: DataFrame, features: list[str],
                id_col: str = "user_id", partitions: int | None = None) -> DataFrame:
    """Per row: ``id``, ``base`` and one ``shap_<feature>`` column per feature.

    The work is CPU-bound per row; ``partitions`` deals the rows out first, for an
    input of fewer partitions than cores.
    """
    if isinstance(tree_model, ForestModel):
        rows = df.select(id_col, *features)
        return _forest_values(tree_model, rows if partitions is None else rows.repartition(partitions), id_col, features)
    # shipped once per executor as a broadcast (bounded by the model size)
    tables_bc = spark.sparkContext.broadcast(merge_tables(leaf_tables(spark, tree_model)))
    m = len(features)
    fields = [T.StructField(id_col, T.LongType()), T.StructField("base", T.DoubleType())]
    fields += [T.StructField(f"shap_{f}", T.DoubleType()) for f in features]
    schema = T.StructType(fields)

    def explain(batches):
        tables = tables_bc.value
        for pdf in batches:
            for start in range(0, len(pdf), SHAP_BATCH):
                part = pdf.iloc[start:start + SHAP_BATCH]
                x = part[features].to_numpy(dtype=float)
                phi, base = tree_shap(tables, x, m)
                out = pd.DataFrame(phi, columns=[f"shap_{f}" for f in features])
                out.insert(0, "base", base)
                out.insert(0, id_col, part[id_col].to_numpy())
                yield out

    rows = df.select(id_col, *features)
    if partitions is not None:
        rows = rows.repartition(partitions)
    return rows.mapInPandas(explain, schema)


def sample_rows(df: DataFrame, n: int | None, id_col: str = "user_id", seed: int = SEED) -> DataFrame:
    """Seeded sample of ``n`` rows (top-n of a seeded id hash; a bounded top-k),
    or every row when ``n`` is None."""
    if n is None:
        return df
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n)


def shap_importance(spark: SparkSession, tree_model, df: DataFrame, features: list[str],
                    n: int | None = None, id_col: str = "user_id", seed: int = SEED,
                    partitions: int | None = None) -> DataFrame:
    """``(feature, mean_abs_shap)``, descending: mean |SHAP| per feature over the
    rows (all of them, or a seeded sample of ``n``)."""
    sv = shap_values(spark, tree_model, sample_rows(df, n, id_col, seed), features, id_col, partitions)
    agg = sv.agg(*[F.avg(F.abs(F.col(f"shap_{f}"))).alias(f) for f in features])
    stack = "stack({n}, {items}) as (feature, mean_abs_shap)".format(
        n=len(features), items=", ".join(f"'{f}', `{f}`" for f in features))
    return agg.select(F.expr(stack)).orderBy(F.desc("mean_abs_shap"), F.asc("feature"))
