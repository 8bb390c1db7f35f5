"""A random forest whose trees do not gather on the driver.

Grown to purity, a forest holds about as many nodes as its bags hold rows; MLlib keeps all
of them, and the statistics of each, in the driver's memory.  Here the rows of a tree's
bag are sent to the tasks that grow it, and what they grow is written as a table: a row
per part of a tree.  The driver holds the few nodes above the parts.  A part is a tree whose bag has
at most ``PART_ROWS`` rows, or a subtree with so many; above, a level is one distributed
aggregate, the label counts per node, drawn feature and bin.

The rules are MLlib's: rows drawn with replacement (a Poisson weight per row and tree),
the square root of the features drawn per node, features cut at quantiles into 32 bins,
splits by Gini gain, no pure node split, sibling leaves of one class merged, the mean of the leaves' shares
as the probability.  The draws are hashes of row, tree and node, so partitioning does not change a tree.

Scoring and attribution pair blocks of rows with parts and add up over the parts: a
part carries the box of its path, and takes the rows inside it.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, scratch_path
from .boosting import _GOLDEN, _MIX_1, _MIX_2, _blocks, binned, quantile_cuts

#: Rows of a bag that one task grows a (sub)tree on.
PART_ROWS = 1 << 17
#: Trees whose upper levels one pass counts.
TREES_AT_ONCE = 50
#: Binary places of a leaf's share: sums over the trees are exact in double.
SHARE_BITS = 40
_ALL = (1 << 64) - 1
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Forest:
    trees: int = 200
    depth: int = 30
    bins: int = 32
    seed: int = 42


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX_2)
    return z ^ (z >> np.uint64(31))


def bag_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bag."""
    z = _mixed(keys + np.uint64(((tree + 1) * _GOLDEN + seed * _MIX_1) & _ALL))
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) / 2.0 ** 53, side="right").astype(np.uint8)


def root_code(tree: int, seed: int) -> np.ndarray:
    return _mixed(np.array([((tree + 1) * _MIX_2 + seed * _GOLDEN) & _ALL], np.uint64))


def drawn_features(codes: np.ndarray, n: int) -> np.ndarray:
    """(nodes, ceil(sqrt(n))): the features each node may split on, ascending."""
    draw = _mixed(codes[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(_GOLDEN))
    return np.sort(np.argsort(draw, axis=1, kind="stable")[:, :math.ceil(math.sqrt(n))], axis=1)


def child_codes(codes: np.ndarray) -> np.ndarray:
    """(nodes, 2): the codes of the left and right children."""
    return _mixed(codes[:, None] * np.uint64(2) + np.array([1, 2], np.uint64)[None, :] + np.uint64(_GOLDEN))


def label_counts(bins, y, w, node, drawn: np.ndarray, n_bins: int) -> np.ndarray:
    """(2, nodes, drawn features, bins): weighted rows, and those of label 1, of the rows' nodes."""
    out = np.empty((2, *drawn.shape, n_bins))
    rows, size = np.arange(len(node)), len(drawn) * n_bins
    for j in range(drawn.shape[1]):
        cell = node * n_bins + bins[rows, drawn[node, j]]
        out[0, :, j] = np.bincount(cell, w, size).reshape(-1, n_bins)
        out[1, :, j] = np.bincount(cell, w * y, size).reshape(-1, n_bins)
    return out


def gini_splits(counts: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node (gain, feature, last bin on the left, rows and ones of the left child); the
    first of equal gains in the order of features and bins.  Gain 0: no split."""
    n, ones = (c[..., :1, :].sum(axis=-1, keepdims=True) for c in counts)
    ln, l1 = (np.cumsum(c, axis=-1)[..., :-1] for c in counts)
    worth = lambda a, b: np.divide(b * (a - b), a, out=np.zeros_like(b), where=a > 0)
    gain = 2 * (worth(n, ones) - worth(ln, l1) - worth(n - ln, ones - l1))
    gain = np.where((ln > 0) & (ln < n) & (gain > 1e-9), gain, 0).reshape(len(drawn), -1)
    best, k = gain.argmax(axis=1), np.arange(len(drawn))
    j, b = np.divmod(best, ln.shape[-1])
    return gain[k, best], drawn[k, j], b, ln[k, j, b], l1[k, j, b]


@dataclass
class Nodes:
    """Nodes in the order they were made; ``left`` is -1 at a leaf, the right child is
    behind the left one.  A row goes left when its bin is at most ``bin``."""
    left: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    rows: np.ndarray               # of the bag, with repeats
    ones: np.ndarray

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        """The leaf each row ends in."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows := rows[self.left[node[rows]] >= 0]):
            now = node[rows]
            node[rows] = self.left[now] + (bins[rows, self.feature[now]] > self.bin[now])
        return node


class _Growing:
    """A tree whose levels are split one by one."""

    def __init__(self, code: np.ndarray, rows: float, ones: float):
        self.left, self.feature, self.bin = (np.full(1, v, np.int64) for v in (-1, 0, 0))
        self.rows, self.ones = np.array([rows], float), np.array([ones], float)
        self.codes, self.depth = code, np.zeros(1, np.int64)

    def mixed_nodes(self, depth: int) -> np.ndarray:
        """Leaves that may be split: both labels, above the last depth."""
        return np.flatnonzero((self.left < 0) & (self.ones > 0) & (self.ones < self.rows) & (self.depth < depth))

    def split(self, at: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """Split the nodes ``at`` that gain; returns which did."""
        gain, feature, b, ln, l1 = found
        do = gain > 0
        at, n = at[do], int(do.sum())
        self.left[at], self.feature[at], self.bin[at] = len(self.left) + 2 * np.arange(n), feature[do], b[do]
        both = lambda a, total: np.column_stack([a, total - a]).ravel()
        self.rows = np.append(self.rows, both(ln[do], self.rows[at]))
        self.ones = np.append(self.ones, both(l1[do], self.ones[at]))
        self.codes = np.append(self.codes, child_codes(self.codes[at]).ravel())
        self.depth = np.append(self.depth, np.repeat(self.depth[at] + 1, 2))
        self.left = np.append(self.left, np.full(2 * n, -1))
        self.feature, self.bin = (np.append(a, np.zeros(2 * n, np.int64)) for a in (self.feature, self.bin))
        return do

    def nodes(self) -> Nodes:
        return Nodes(self.left, self.feature, self.bin, self.rows, self.ones)


def grow_part(bins: np.ndarray, y: np.ndarray, w: np.ndarray, code: np.ndarray, depth: int, n_bins: int) -> Nodes:
    """The (sub)tree of the rows of one task."""
    t = _Growing(code, w.sum(), (w * y).sum())
    node = np.zeros(len(y), np.int64)
    at = t.mixed_nodes(depth)
    while len(at):
        place = np.full(len(t.left), -1)
        place[at] = np.arange(len(at))
        keep = place[node] >= 0
        bins, y, w, node = bins[keep], y[keep], w[keep], node[keep]
        drawn = drawn_features(t.codes[at], bins.shape[1])
        behind = len(t.left)
        t.split(at, gini_splits(label_counts(bins, y, w, place[node], drawn, n_bins), drawn))
        to = t.left[node]
        right = bins[np.arange(len(node)), t.feature[node]] > t.bin[node]
        node = np.where(to >= 0, to + right, node)
        at = t.mixed_nodes(depth)
        at = at[at >= behind]
    return merged(t.nodes())


def merged(t: Nodes) -> Nodes:
    """Sibling leaves that predict the same class become one leaf, from the bottom up."""
    left, says = t.left.copy(), 2 * t.ones > t.rows
    while True:
        inner = np.flatnonzero(left >= 0)
        k = left[inner]
        alike = inner[(left[k] < 0) & (left[k + 1] < 0) & (says[k] == says[k + 1])]
        if not len(alike):
            break
        left[alike] = -1
        says[alike] = says[t.left[alike]]
    kept = np.zeros(len(left), bool)
    kept[0] = True
    level = np.array([0])
    while len(level := level[left[level] >= 0]):
        level = np.concatenate([left[level], left[level] + 1])
        kept[level] = True
    place = np.cumsum(kept) - 1
    left = np.where(left >= 0, place[left], -1)
    return Nodes(*(a[kept] for a in (left, t.feature, t.bin, t.rows, t.ones)))


_PART = ("tree int, part int, low binary, high binary, share binary, left binary, feature binary, "
         "bin binary, rows binary, ones binary")
_KINDS = {"left": np.int32, "feature": np.int16, "bin": np.uint8, "rows": np.float32, "ones": np.float32}
_PLACE = {"low": np.int16, "high": np.int16, "share": np.float64}


def _upper(held, n_rows: int, n_features: int, n_bins: int, how: Forest) -> list[_Growing]:
    """The levels of all trees above the parts, by one aggregate a level."""
    trees = []
    for start in range(0, how.trees, TREES_AT_ONCE):
        numbers = range(start, min(start + TREES_AT_ONCE, how.trees))
        if n_rows <= PART_ROWS:
            trees += [_Growing(root_code(t, how.seed), 0, 0) for t in numbers]
            continue

        def sizes(blocks, numbers=numbers):
            total = np.zeros((len(numbers), 2))
            for keys, bins, y, *_ in blocks:
                for i, t in enumerate(numbers):
                    w = bag_weights(keys, t, how.seed)
                    total[i] += w.sum(), (w * y).sum()
            yield total
        add = lambda a, b: a + b
        some = [_Growing(root_code(t, how.seed), *s) for t, s in zip(numbers, held.mapPartitions(sizes).treeReduce(add))]
        tried: list[set] = [set() for _ in some]
        while True:
            at = [np.array([k for k in t.mixed_nodes(how.depth) if t.rows[k] > PART_ROWS and k not in done], np.int64)
                  for t, done in zip(some, tried)]
            if not any(map(len, at)):
                break
            drawn = [drawn_features(t.codes[a], n_features) for t, a in zip(some, at)]

            def counts(blocks, numbers=numbers, now=[t.nodes() for t in some], at=at, drawn=drawn):
                total = [np.zeros((2, *d.shape, n_bins)) for d in drawn]
                for keys, bins, y, *_ in blocks:
                    for i, t in enumerate(numbers):
                        if len(at[i]):
                            w, place = bag_weights(keys, t, how.seed), np.full(len(now[i].left), -1)
                            place[at[i]] = np.arange(len(at[i]))
                            node = place[now[i].of_bins(bins)]
                            in_ = np.flatnonzero((node >= 0) & (w > 0))
                            total[i] += label_counts(bins[in_], y[in_], w[in_], node[in_], drawn[i], n_bins)
                yield total
            sums = held.mapPartitions(counts).treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])
            for t, a, d, s, done in zip(some, at, drawn, sums, tried):
                if len(a):
                    done.update(a.tolist())
                    t.split(a, gini_splits(s, d))
        trees += some
    return trees


def _boxes(t: _Growing, n_features: int, n_bins: int) -> dict[int, tuple]:
    """Per node the bins its path keeps (low < bin <= high) and the share of the rows that
    the path keeps by each feature."""
    out, todo = {}, [(0, np.full(n_features, -1), np.full(n_features, n_bins), np.ones(n_features))]
    while todo:
        k, low, high, share = todo.pop()
        out[k] = (low, high, share)
        if t.left[k] < 0:
            continue
        f = t.feature[k]
        for side in (0, 1):
            c, lo, hi, sh = int(t.left[k]) + side, low.copy(), high.copy(), share.copy()
            sh[f] *= t.rows[c] / t.rows[k]
            if side:
                lo[f] = max(lo[f], t.bin[k])
            else:
                hi[f] = min(hi[f], t.bin[k])
            todo.append((c, lo, hi, sh))
    return out


def fit_forest(rows: DataFrame, features: list[str], label: str, id_col: str = "user_id",
               how: Forest | None = None) -> ForestModel:
    """Fit on the rows with a 0/1 ``label``; the trees are written under the shared checkpoint folder."""
    how = how or Forest()
    spark, m = rows.sparkSession, len(features)
    checkpoint_dir(spark)
    cuts = quantile_cuts(rows, features, how.bins)
    n_bins = 1 + max(map(len, cuts)) + 1
    held = _blocks(rows, features, label, id_col, cuts, 0.0).persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch_path(spark, f"forests/{uuid.uuid4().hex}")
    try:
        n_rows = held.map(lambda b: len(b[2])).sum()
        upper = spark.sparkContext.broadcast(_upper(held, n_rows, m, n_bins, how))

        def dealt(block):
            keys, bins, y, *_ = block
            for t, top in enumerate(upper.value):
                w = bag_weights(keys, t, how.seed)
                used = np.flatnonzero(w)
                node = top.nodes().of_bins(bins[used])
                for part in np.unique(node).tolist():
                    r = used[node == part]
                    yield t, part, bytearray(bins[r].tobytes()), bytearray(y[r].astype(np.uint8).tobytes()), bytearray(w[r].tobytes())

        def grown(key, pdf):
            import pandas as pd
            t, part = map(int, key)
            top = upper.value[t]
            bins, y, w = (np.frombuffer(b"".join(pdf[c]), np.uint8) for c in ("bins", "y", "w"))
            got = grow_part(bins.reshape(-1, m), y.astype(float), w.astype(float), top.codes[part:part + 1],
                            how.depth - int(top.depth[part]), n_bins)
            return pd.DataFrame([_row(t, part, _boxes(top, m, n_bins)[part], got)])

        sent = spark.createDataFrame(held.flatMap(dealt), "tree int, part int, bins binary, y binary, w binary")
        tasks = max(2 * spark.sparkContext.defaultParallelism, how.trees // 4, 1)
        sent.repartition(tasks, "tree", "part").groupBy("tree", "part").applyInPandas(grown, _PART).write.parquet(path)
    finally:
        held.unpersist()
    if n_rows > PART_ROWS:
        path = _merged_parts(spark, path, upper.value, m, n_bins)
    return ForestModel(features, cuts, how, path)


def _merged_parts(spark: SparkSession, path: str, upper: list[_Growing], n_features: int, n_bins: int) -> str:
    """:func:`merged` above the parts: sibling parts that are one leaf each, of one class,
    become one part.  Returns where the table is."""
    parts = spark.read.parquet(path)
    flat: dict[int, set] = {}
    for r in parts.where(F.length("left") == np.dtype(_KINDS["left"]).itemsize).select("tree", "part").collect():
        flat.setdefault(r["tree"], set()).add(r["part"])
    gone, new = [], []
    for i, leaves in flat.items():
        t, now = upper[i], set(leaves)
        says = 2 * t.ones > t.rows
        for k in np.flatnonzero(t.left >= 0)[::-1].tolist():
            a, b = int(t.left[k]), int(t.left[k]) + 1
            if {a, b} <= now and says[a] == says[b]:
                now = now - {a, b} | {k}
                says[k] = says[a]
        gone += [(i, k) for k in leaves - now]
        boxes = _boxes(t, n_features, n_bins)
        new += [_row(i, k, boxes[k], Nodes(np.array([-1]), *(np.zeros(1, int),) * 2, t.rows[k:k + 1], t.ones[k:k + 1]))
                for k in now - leaves]
    if not new:
        return path
    kept = parts.join(F.broadcast(spark.createDataFrame(gone, "tree int, part int")), ["tree", "part"], "left_anti")
    kept.unionByName(spark.createDataFrame(new, _PART)).write.parquet(f"{path}-merged")
    return f"{path}-merged"


def _row(tree: int, part: int, box: tuple, nodes: Nodes) -> dict:
    return ({"tree": tree, "part": part} | {c: b.astype(k).tobytes() for (c, k), b in zip(_PLACE.items(), box)}
            | {c: getattr(nodes, c).astype(k).tobytes() for c, k in _KINDS.items()})


def _part(r: dict) -> tuple[dict, Nodes]:
    """The place and the nodes of a row of the part table."""
    place = {c: np.frombuffer(r[c], k) for c, k in _PLACE.items()}
    return place, Nodes(*(np.frombuffer(r[c], k) for c, k in _KINDS.items()))


class ForestModel:
    """A fitted forest: the table of its parts, and the cuts of the bins.  It scores like a
    fitted pipeline and is saved as one."""

    def __init__(self, features: list[str], cuts: list[np.ndarray], how: Forest, path: str):
        self.features, self.cuts, self.how, self.path = list(features), cuts, how, path
        self.stages = [self]

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def with_sums(self, df: DataFrame, names: list[str], of_part: Callable, whole: bool = False) -> DataFrame:
        """``df`` with a double column per name: the sum over all parts of what
        ``of_part(place, nodes, bins, values)`` gives for the rows in the part's box, or
        for ``whole`` for all rows."""
        import pyarrow as pa
        spark, cuts, features, width = df.sparkSession, self.cuts, self.features, len(names)
        path = scratch_path(spark, f"forest-blocks/{uuid.uuid4().hex}")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.column_stack([b.column(f"_x{i}").cast(pa.float64()).to_numpy(zero_copy_only=False)
                                         for i in range(len(features))])
                    out = io.BytesIO()
                    own = pa.RecordBatch.from_arrays(b.columns[:-len(features)], names=b.schema.names[:-len(features)])
                    with pa.ipc.new_stream(out, own.schema) as w:
                        w.write_batch(own)
                    yield pa.RecordBatch.from_pylist([{"block": uuid.uuid4().hex, "x": x.tobytes(), "own": out.getvalue()}])

        cells = df.select("*", *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
        cells.mapInArrow(packed, "block string, x binary, own binary").write.parquet(path)
        blocks = spark.read.schema("block string, x binary, own binary").parquet(path)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                for i in range(b.num_rows):
                    r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                    x = np.frombuffer(r["x"]).reshape(-1, len(features))
                    bins = binned(x, cuts)
                    place, nodes = _part(r)
                    here = np.arange(len(x)) if whole else np.flatnonzero(((bins > place["low"]) & (bins <= place["high"])).all(axis=1))
                    if r["block"] not in sums:
                        sums[r["block"]] = np.zeros((len(x), width))
                    if len(here):
                        sums[r["block"]][here] += of_part(place, nodes, bins[here], x[here])
            for block, s in sums.items():
                yield pa.RecordBatch.from_pylist([{"block": block, "sums": s.tobytes()}])

        tasks = 2 * spark.sparkContext.defaultParallelism
        pairs = self.parts(spark).repartition(tasks, "tree", "part").crossJoin(blocks.drop("own"))
        sums = pairs.mapInArrow(summed, "block string, sums binary").groupBy("block").agg(
            F.sort_array(F.collect_list("sums")).alias("sums"))

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for own, sums_ in zip(b.column("own"), b.column("sums")):
                    rows = pa.ipc.open_stream(own.as_py()).read_next_batch()
                    total = sum(np.frombuffer(s) for s in sums_.as_py()).reshape(-1, width)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(total[:, i]) for i in range(width))],
                                                     names=[*rows.schema.names, *names])

        out = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
        return blocks.select("block", "own").join(sums, "block").select("own", "sums").mapInArrow(unpacked, out)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``: the mean of the leaves' shares of each class."""
        def share(place, nodes, bins, x):
            k = nodes.of_bins(bins)
            return (np.rint(nodes.ones[k] / nodes.rows[k].astype(float) * 2.0 ** SHARE_BITS) / 2.0 ** SHARE_BITS)[:, None]
        p = F.col("_p") / self.how.trees
        return self.with_sums(df, ["_p"], share).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_p")

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(about["features"], [np.array(c, float) for c in about["cuts"]], Forest(**about["how"]), f"{path}/parts")


class _Writer:
    """Saves a model in the way a pipeline is saved: ``write().overwrite().save(path)``."""

    def __init__(self, model: ForestModel):
        self.model, self.mode = model, "error"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        m, spark = self.model, SparkSession.active()
        m.parts(spark).write.mode(self.mode).parquet(f"{path}/parts")
        about = json.dumps({"features": m.features, "cuts": [c.tolist() for c in m.cuts], "how": asdict(m.how)})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode(self.mode).text(f"{path}/about")
