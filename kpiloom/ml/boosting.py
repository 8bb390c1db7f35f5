"""Second-order gradient boosting of regression trees for a binary label.

Every tree minimises the second-order expansion of the log-loss with an L2 penalty on
its leaves: with G and H the sums of gradients and hessians of a node, a leaf is worth
-G / (H + l2), and a split gains (GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)) / 2.
Features are cut once at quantiles; a level of a tree then needs one distributed
aggregate, the sums of gradient and hessian per node, feature and bin, whose size is
that of the model (nodes x features x bins), whatever the data.  The tasks' sums of a
feature meet in one task, which finds the feature's best split of each node; only these
splits reach the driver.

The rows stay on the executors as packed blocks with their margins.  That is an RDD of
numpy arrays: a run makes rounds x depth small passes (1,000 by default), and planning
each as a query would cost more than the pass.  A table of a block or less is one task's.  Gradients are rounded to fixed-point
numbers whose sums are exact in double, so neither partitioning nor the order of
addition changes a tree.  Margins are brought up to date, and written to the
checkpoint folder, every few rounds; in between a pass adds the newest trees itself, so
a lost executor costs a re-read of a checkpoint, never a replay of the run.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK = 1 << 16
#: Up to so many rows, one task runs all rounds; beyond, every level is a distributed
#: pass.  The sums, and so the trees, are the same.
ONE_TASK = 1 << 16
#: Rounds between two updates of the stored margins.
REFRESH = 10
#: Rows of a task of a pass: fewer when that uses more cores, but not less than the least,
#: since the driver keeps a record of each task of each pass.
TASK_ROWS, LEAST_ROWS = 1 << 20, 1 << 15
_GOLDEN, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Boosting:
    """Parameters of a run; the defaults are the original's, and its library's."""
    rounds: int = 200
    depth: int = 5
    rate: float = 0.08
    row_share: float = 0.9         # of the rows, drawn for each tree
    column_share: float = 0.9      # of the features, drawn for each tree
    l2: float = 1.0
    min_hessian: float = 1.0       # of a child
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order they were made; ``left`` is -1 at a leaf.  A row goes left
    when its value is at most the threshold, so NaN goes right."""
    left: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    bin: np.ndarray                # last bin that goes left
    cover: np.ndarray              # hessian sum
    value: np.ndarray

    def at(self, goes_left, n: int) -> np.ndarray:
        """The node each of n rows ends in; ``goes_left(rows, nodes)`` decides."""
        node = np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows := rows[self.left[node[rows]] >= 0]):
            now = node[rows]
            node[rows] = self.left[now] + ~goes_left(rows, now)
        return node

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.at(lambda r, k: bins[r, self.feature[k]] <= self.bin[k], len(bins))

    def of_values(self, x: np.ndarray) -> np.ndarray:
        return self.at(lambda r, k: x[r, self.feature[k]] <= self.threshold[k], len(x))


def drawn(keys: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree is grown on: a hash of the row's key and the tree."""
    if share >= 1:
        return np.ones(len(keys), bool)
    salt = ((tree + 1) * _GOLDEN + seed * _MIX_1) & ((1 << 64) - 1)
    z = keys.astype(np.uint64) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX_2)
    return (z ^ (z >> np.uint64(31))) < np.uint64(min(int(share * 2 ** 64), 2 ** 64 - 1))


def drawn_columns(n: int, tree: int, share: float, seed: int) -> np.ndarray:
    """The features a tree may split on."""
    keep = max(1, round(share * n))
    return np.sort(np.random.default_rng((seed, tree)).permutation(n)[:keep])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fixed_bits(rows: int) -> int:
    """Binary places of gradients whose sum over ``rows`` rows is exact in double."""
    return min(32, 52 - math.ceil(math.log2(max(rows, 2))))


def node_sums(bins, y, margin, mask, node, n_nodes: int, n_bins: int, bits: int) -> np.ndarray:
    """(2, nodes, features, bins): fixed-point sums of gradient and hessian of the rows
    in ``mask``, whose ``node`` (within the level) is not negative."""
    p = sigmoid(margin)
    scale = 2.0 ** bits
    rows = np.flatnonzero(mask & (node >= 0))
    g, h = np.rint((p - y)[rows] * scale), np.rint((p * (1 - p))[rows] * scale)
    out = np.empty((2, n_nodes, bins.shape[1], n_bins))
    for f in range(bins.shape[1]):
        cell = node[rows] * n_bins + bins[rows, f]
        for i, w in enumerate((g, h)):
            out[i, :, f] = np.bincount(cell, w, n_nodes * n_bins).reshape(n_nodes, n_bins)
    return out


def best_splits(sums: np.ndarray, columns: np.ndarray, how: Boosting) -> tuple[np.ndarray, ...]:
    """Per node (gain, feature, last bin on the left, G and H of the left child); the
    first of equal gains in the order of features and bins.  Gain 0: no split."""
    g, h = sums
    gl, hl = np.cumsum(g, axis=2)[..., :-1], np.cumsum(h, axis=2)[..., :-1]
    total_g, total_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    gr, hr = total_g - gl, total_h - hl
    worth = lambda a, b: a * a / (b + how.l2)
    gain = (worth(gl, hl) + worth(gr, hr) - worth(total_g, total_h)) / 2
    allowed = np.zeros(g.shape[1], bool)
    allowed[columns] = True
    gain = np.where((hl >= how.min_hessian) & (hr >= how.min_hessian) & allowed[None, :, None], gain, 0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    f, b = np.divmod(best, gain.shape[2])
    k = np.arange(len(gain))
    return flat[k, best], f, b, gl[k, f, b], hl[k, f, b]


def level_splits(sums: np.ndarray, columns: np.ndarray, how: Boosting, bits: int) -> tuple[np.ndarray, ...]:
    """Per node of a level G and H, and what :func:`best_splits` finds, of fixed-point sums."""
    sums = sums / 2.0 ** bits
    return (*sums[:, :, 0].sum(axis=2), *best_splits(sums, columns, how))


def best_feature(found: list[tuple[int, tuple[np.ndarray, ...]]]) -> tuple[np.ndarray, ...]:
    """:func:`level_splits` of all features, of those of single ones."""
    found = sorted(found, key=lambda x: x[0])
    g, h, gain, feature, last, gl, hl = (np.array(c) for c in zip(*(s for _, s in found)))
    best, k = gain.argmax(axis=0), np.arange(gain.shape[1])
    return (g[0], h[0], gain[best, k], np.array([f for f, _ in found])[best], last[best, k], gl[best, k], hl[best, k])


def grow(splits_of, how: Boosting, tree: int, n_features: int, cuts: list[np.ndarray]) -> Tree:
    """One tree; ``splits_of(partial tree, features, first node of the level, nodes)`` gives
    the level's splits (:func:`level_splits`)."""
    columns = drawn_columns(n_features, tree, how.column_share, how.seed)
    left, feature, threshold, last, grad, hess = [-1], [0], [0.0], [0], [0.0], [0.0]

    def made() -> Tree:
        value = [-how.rate * g / (h + how.l2) for g, h in zip(grad, hess)]
        return Tree(np.array(left), np.array(feature), np.array(threshold), np.array(last), np.array(hess),
                    np.where(np.array(left) < 0, value, 0.0))

    first, n = 0, 1
    for _ in range(how.depth):
        g, h, gain, f, b, gl, hl = splits_of(made(), columns, first, n)
        if first == 0:
            grad[0], hess[0] = g[0], h[0]
        behind = first + n
        for k in np.flatnonzero(gain > 1e-9).tolist():
            at = first + k
            left[at], feature[at], last[at] = len(left), int(f[k]), int(b[k])
            threshold[at] = float(cuts[f[k]][b[k]])
            left += [-1, -1]
            feature += [0, 0]
            threshold += [0.0, 0.0]
            last += [0, 0]
            grad += [gl[k], grad[at] - gl[k]]
            hess += [hl[k], hess[at] - hl[k]]
        first, n = behind, len(left) - behind
        if not n:
            break
    return made()


def quantile_cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Per feature the ascending thresholds between its bins, at most ``bins`` - 1:
    different quantiles below the maximum, from one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    finite = {f: F.when(~F.isnan(f), F.col(f)) for f in features}
    got = rows.agg(*[F.percentile_approx(c, shares, 100_000).alias(f) for f, c in finite.items()],
                   *[F.max(c).alias(f"max_{f}") for f, c in finite.items()]).first()
    return [np.array(sorted({q for q in got[f] or [] if q < got[f"max_{f}"]})) for f in features]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many thresholds are below it; NaN in the bin after all."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), len(c), np.searchsorted(c, x[:, f], side="left"))
    return out


def boosted_in_task(blocks: list, cuts: list[np.ndarray], how: Boosting, n_bins: int, bits: int) -> list[Tree]:
    """All rounds over the blocks of one task."""
    keys, bins, y, margin = (np.concatenate(c) for c in zip(*blocks))
    trees: list[Tree] = []
    for t in range(how.rounds):
        mask = drawn(keys, t, how.row_share, how.seed)

        def splits_of(tree, columns, first, count, mask=mask, margin=margin):
            sums = node_sums(bins, y, margin, mask, tree.of_bins(bins) - first, count, n_bins, bits)
            return level_splits(sums, columns, how, bits)

        trees.append(grow(splits_of, how, t, len(cuts), cuts))
        margin = margin + trees[-1].value[trees[-1].of_bins(bins)]
    return trees


def pass_tasks(rows: int, cores: int) -> int:
    """Tasks of a pass over so many rows."""
    return max(1, min(cores, -(-rows // LEAST_ROWS)), -(-rows // TASK_ROWS))


def _blocks(rows: DataFrame, features: list[str], label: str, id_col: str, cuts: list[np.ndarray], base: float):
    """RDD of (keys, bins, labels, margins), ``BLOCK`` rows at most each."""
    packed = rows.select(F.xxhash64(id_col, *features).alias("_key"), *features, F.col(label).cast("double").alias("_y"))

    def pack(batches):
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(features))])
            y = b.column(len(features) + 1).to_numpy(zero_copy_only=False)
            keys = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(y), BLOCK):
                part = slice(i, i + BLOCK)
                yield pd.DataFrame({"keys": [keys[part].tobytes()], "bins": [binned(x[part], cuts).tobytes()],
                                    "y": [y[part].astype(np.uint8).tobytes()]})

    def to_arrow(batches):
        import pyarrow as pa
        for d in pack(batches):
            yield pa.RecordBatch.from_pandas(d, preserve_index=False)

    def unpack(r):
        y = np.frombuffer(r.y, np.uint8).astype(float)
        return (np.frombuffer(r.keys, np.uint64), np.frombuffer(r.bins, np.uint8).reshape(len(y), -1), y,
                np.full(len(y), base))

    return packed.mapInArrow(to_arrow, "keys binary, bins binary, y binary").rdd.map(unpack)


def fit_boosted(rows: DataFrame, features: list[str], label: str, id_col: str = "user_id",
                how: Boosting | None = None) -> BoostedModel:
    """Fit on the rows with a 0/1 ``label``.  Rows are known by their id and features, so
    a tree's draw does not depend on partitioning.  No rows, or one class only, gives
    a model without trees (its base is the bounded log-odds of the share)."""
    how = how or Boosting()
    spark = rows.sparkSession
    checkpoint_dir(spark)
    n, ones = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    share = min(max((ones or 0.0) / max(n, 1), 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    if not n or not 0 < ones < n:
        return BoostedModel(features, base, [], how)
    cuts = quantile_cuts(rows, features, how.bins)
    n_bins, bits = 1 + max(map(len, cuts)) + 1, fixed_bits(n)
    held = _blocks(rows, features, label, id_col, cuts, base)
    if n <= ONE_TASK:
        found = held.coalesce(1).mapPartitions(lambda b: [boosted_in_task(list(b), cuts, how, n_bins, bits)]).first()
        return BoostedModel(features, base, found, how)
    tasks = pass_tasks(n, spark.sparkContext.defaultParallelism)
    held = held.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[Tree] = []
    stored = 0                                     # trees that the stored margins hold
    try:
        for t in range(how.rounds):
            if t - stored == REFRESH:
                newest, stored = trees[stored:], t
                moved = held.map(lambda b, ts=newest: (*b[:3], b[3] + sum(k.value[k.of_bins(b[1])] for k in ts)))
                moved = moved.persist(StorageLevel.MEMORY_AND_DISK)
                moved.checkpoint()
                moved.count()
                held.unpersist()
                held = moved

            def splits_of(tree, columns, first, count, t=t, newest=trees[stored:], held=held):
                def part(blocks):
                    total = np.zeros((2, count, len(cuts), n_bins))
                    for keys, bins, y, margin in blocks:
                        for k in newest:
                            margin = margin + k.value[k.of_bins(bins)]
                        node = tree.of_bins(bins) - first
                        total += node_sums(bins, y, margin, drawn(keys, t, how.row_share, how.seed), node,
                                           count, n_bins, bits)
                    yield from ((f, total[:, :, f:f + 1]) for f in columns.tolist())

                sums = held.mapPartitions(part).reduceByKey(lambda a, b: a + b, min(len(columns), tasks))
                return best_feature(sums.mapValues(lambda s: level_splits(s, np.array([0]), how, bits)).collect())

            trees.append(grow(splits_of, how, t, len(features), cuts))
    finally:
        held.unpersist()
    return BoostedModel(features, base, trees, how)


class BoostedModel:
    """A fitted run.  It scores like a fitted pipeline, and is saved as a node table."""

    def __init__(self, features: list[str], base: float, trees: list[Tree], how: Boosting):
        self.features, self.base, self.trees, self.how = list(features), base, trees, how
        self.stages = [self]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.of_values(x)] for t in self.trees), np.zeros(len(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction``, the margins of both classes."""
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def margin(cells: pd.DataFrame) -> pd.Series:
            return pd.Series(held.value.margins(cells.to_numpy(dtype=float)))

        m = margin(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))
        return df.withColumn("_margin", m).withColumn(
            "rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin")))).drop("_margin")

    def nodes(self) -> list[dict]:
        """Per tree the nodes, id -> (left, right, feature, threshold, cover, value)."""
        return [{i: (int(t.left[i]), int(t.left[i]) + 1 if t.left[i] >= 0 else -1, int(t.feature[i]),
                     float(t.threshold[i]), float(t.cover[i]), float(t.value[i])) for i in range(len(t.left))}
                for t in self.trees]

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        rows = spark.read.schema(_NODE).parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        trees = [Tree(*(g[c].to_numpy() for c in ("left", "feature", "threshold", "bin", "cover", "value")))
                 for _, g in rows.groupby("tree", sort=True)]
        return cls(about["features"], about["base"], trees, Boosting(**about["how"]))


_NODE = "tree int, node int, left long, feature long, threshold double, bin long, cover double, value double"


class _Writer:
    """Saves a model in the way a pipeline is saved: ``write().overwrite().save(path)``."""

    def __init__(self, model: BoostedModel):
        self.model, self.mode = model, "error"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        m, spark = self.model, SparkSession.active()
        rows = [(i, j, int(t.left[j]), int(t.feature[j]), float(t.threshold[j]), int(t.bin[j]), float(t.cover[j]),
                 float(t.value[j])) for i, t in enumerate(m.trees) for j in range(len(t.left))]
        spark.createDataFrame(rows, _NODE).coalesce(1).write.mode(self.mode).parquet(f"{path}/nodes")
        about = json.dumps({"features": m.features, "base": m.base, "how": asdict(m.how)})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode(self.mode).text(f"{path}/about")
