"""Hard negatives by inner product, with pruning on coordinates.

Rows are tiled by label and length class.  A tile holds, beside its vectors, the order
of its rows along every coordinate of their unit vectors.  An anchor that looks for
scores of ``low`` or more in a tile needs a cosine of at least low / (its length x the
tile's largest length): a tile that cannot reach that is skipped, and on a coordinate
the cosine leaves an interval of feasible values.  The intervals on the anchor's
largest coordinates are read off the sorted lists, the shortest list is cut with the
others, and what remains is verified by exact integer products.  ``low`` rises with
the best scores found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written
from .search import best_of

#: Positives of an anchor, and negatives of each positive.
POSITIVES = 5
NEGATIVES = 5
#: A negative scores from 80 to 100 hundredths of the positive.
BAND = (80, 100)
#: Rows in a tile, and length classes per doubling.
TILE = 2048
CLASSES = 8
#: Coordinates that prune a tile.
FOCUS = 4
#: Anchors of a block: what the driver and each task hold of them at once.
ANCHORS = 4096
#: Components at or beyond this do not take part: inner products must fit 64 bits.
LARGEST = float(1 << 20)
#: Slack on bounds computed in doubles.
EPSILON = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound & (F.size("v") > 0)).select(
        "vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(label, dim, length, ids, data, order): about ``tile`` rows of one label and length
    class at most, as packed 64- and 32-bit integers, and for every coordinate the rows
    in ascending order of its share of their length (packed 32-bit integers)."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    length = F.when(squares > 0, F.floor(F.log2(squares) * (CLASSES / 2))).otherwise(-1).cast("int")
    keyed = rows.withColumns({"dim": F.size("v"), "length": length})
    key = ["label", "dim", "length"]
    parts = written(keyed.groupBy(*key).agg(F.ceil(F.count("*") / tile).alias("parts")).where("parts > 1"),
                    "negatives-parts")
    dealt = keyed.join(parts, key, "left").withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "v"), F.coalesce("parts", F.lit(1))))
    packed = dealt.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
    packed = packed.select(*key, F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()

    def index(batches):
        for b in batches:
            out = []
            for dim, ids, v in zip(b.column(1).to_pylist(), b.column(3), b.column(4)):
                ids = ids.values.to_numpy()
                x = v.values.to_numpy().reshape(len(ids), dim)
                out.append((ids.astype("<i8").tobytes(), x.astype("<i4").tobytes(),
                            np.argsort(unit(x)[0], axis=0, kind="stable").T.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *(pa.array([o[i] for o in out], pa.binary()) for i in range(3))],
                names=["label", "dim", "length", "ids", "data", "order"])

    return written(packed.mapInArrow(
        index, f"label {kind}, dim int, length int, ids binary, data binary, order binary"), "negatives-tiles")


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows (zero ones stay zero) and lengths."""
    x = x.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(length > 0, length, 1)[:, None], length


class Tile:
    """A tile as an index: exact products of the rows that coordinates leave over."""

    def __init__(self, dim: int, ids: bytes, data: bytes, order: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(data, "<i4").reshape(-1, dim)
        self.order = np.frombuffer(order, "<i4").reshape(dim, -1)
        self.unit, length = unit(self.x)
        self.least, self.most = length.min(), length.max()
        self.wide: np.ndarray | None = None
        self.sorted: dict[int, np.ndarray] = {}

    def column(self, f: int) -> np.ndarray:
        """Values of coordinate f in ascending order."""
        if f not in self.sorted:
            self.sorted[f] = self.unit[self.order[f], f]
        return self.sorted[f]

    def cosine(self, length: float, low: float) -> float:
        """The cosine that a row needs for a score of ``low`` with an anchor."""
        reach = length * (self.most if low > 0 else self.least)
        return low / reach if reach > 0 else (2.0 if low > 0 else -2.0)

    def candidates(self, q: np.ndarray, length: float, low: float, focus: int) -> np.ndarray | None:
        """Rows that may score ``low`` or more with an anchor of unit vector q; None for all."""
        t = self.cosine(length, low) - EPSILON
        if t > 1:
            return np.zeros(0, np.int64)
        if t <= -1:
            return None
        ranges = []
        for f in np.argsort(-np.abs(q), kind="stable")[:focus].tolist():
            spread = np.sqrt(max((1 - q[f] * q[f]) * (1 - t * t), 0.0))
            low_f = -2.0 if q[f] <= -t else q[f] * t - spread - EPSILON
            high_f = 2.0 if q[f] >= t else q[f] * t + spread + EPSILON
            i, j = np.searchsorted(self.column(f), (low_f, high_f), side="left")
            ranges.append((j - i, f, i, j, low_f, high_f))
        ranges.sort()
        n, f, i, j, _, _ = ranges[0]
        if n == len(self.ids):
            return None
        rows = self.order[f, i:j]
        for _, f, _, _, low_f, high_f in ranges[1:]:
            at = self.unit[rows, f]
            rows = rows[(at >= low_f) & (at <= high_f)]
        return rows

    def scores(self, anchor: np.ndarray, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the given rows."""
        if rows is None:
            if self.wide is None:
                self.wide = self.x.astype(np.int64)
            return self.ids, self.wide @ anchor
        return self.ids[rows], self.x[rows].astype(np.int64) @ anchor


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by smaller id."""
    if len(ids) > 8 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= cut
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


_FIRST = "a bigint, bound bigint, other_id bigint, score bigint"


def _batch(found: dict) -> pa.RecordBatch:
    """Rows of {(a, bound): (ids, scores)}."""
    n = [len(ids) for ids, _ in found.values()]
    of = np.repeat(np.array(list(found) or np.zeros((0, 2)), np.int64).reshape(-1, 2), n, axis=0)
    ids, scores = (np.concatenate([np.zeros(0, np.int64), *(v[i] for v in found.values())]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (of[:, 0], of[:, 1], ids, scores)],
                                      names=["a", "bound", "other_id", "score"])


def _scan(tiled: DataFrame, block: list, same: bool, k: int, focus: int, band: tuple[int, int]) -> DataFrame:
    """Rows (a, bound, other_id, score) of each task's first k partners.

    ``block`` lists (a, vec_id, label, vector, bounds).  With ``same`` the partners
    have the anchor's label and any score, and bound is 0; else they have another
    label, and there are k for each bound, scoring from band[0] to band[1] hundredths of it.
    """
    held = tiled.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        anchors = []
        for a, vec_id, label, v, bounds in held.value:
            x = np.array(v, np.int64)
            q, length = unit(x[None, :])
            anchors.append((a, vec_id, label, x, q[0], length[0], bounds))
        found: dict = {}

        def offer(key, ids, scores) -> None:
            if key in found:
                ids, scores = np.concatenate([found[key][0], ids]), np.concatenate([found[key][1], scores])
            if len(ids):
                found[key] = first_of(ids, scores, k)

        def least(key, low):
            """The lowest score that can still be among the first k."""
            return max(low, int(found[key][1][-1])) if key in found and len(found[key][1]) == k else low

        for b in batches:
            for label, dim, ids, data, order in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                tile = None
                for a, vec_id, own, x, q, length, bounds in anchors:
                    if len(x) != dim or (own == label) != same:
                        continue
                    tile = tile or Tile(dim, ids, data, order)
                    if same:
                        low = least((a, 0), -(1 << 62))
                    else:
                        lows = [least((a, p), -(-band[0] * p // band[1])) for p in bounds]
                        low = min(lows)
                    rows = tile.candidates(q, length, low, focus)
                    if rows is not None and not len(rows):
                        continue
                    other, scores = tile.scores(x, rows)
                    if same:
                        some = (scores >= low) & (other != vec_id)
                        offer((a, 0), other[some], scores[some])
                        continue
                    for p, low in zip(bounds, lows):
                        some = (scores >= low) & (scores <= p)
                        if some.any():
                            offer((a, p), other[some], scores[some])
        yield _batch(found)

    return tiled.mapInArrow(run, _FIRST)


def mine_hard_negatives(vectors: DataFrame, anchor_modulus: int = 100, id_col: str = "vec_id",
                        vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
                        positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
                        tile: int = TILE, focus: int = FOCUS, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``anchor_modulus``; rows equal in id,
    label and vector are one anchor.  Its positives are the first rows of its label with
    another id, its negatives, for each positive, the first rows of other labels with
    band[0] * positive score <= band[1] * negative score <= band[1] * positive score.
    Higher scores come first, ties by smaller id.  Rows with a null id, label or
    vector, an empty vector, or a component that is null, not finite, or 2^20 or more
    in size take no part; vectors of different lengths are no partners.  A repeated row
    is a partner as often as it stands.  Anchors without positives, and positives
    without negatives, return nothing.  Other columns are ignored; an empty table
    gives no rows.  Anchors go in blocks of about ``block``, each over all tiles.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, id_col, vector_col, label_col, scale)
    tiled = tiles(rows, tile)
    anchors = written(rows.where(F.col("vec_id") % anchor_modulus == 0).distinct()
                      .withColumn("a", F.monotonically_increasing_id()), "negatives-anchors")
    n = anchors.count()
    blocks = 1 if n <= block else -(-2 * n // block)
    part = F.pmod(F.xxhash64("a"), F.lit(blocks))
    order = [F.desc("score"), F.asc("other_id")]
    salt = F.xxhash64("other_id")
    near = far = None
    for i in range(blocks):
        own = [(r.a, r.vec_id, r.label, r.v, [0]) for r in anchors.where(part == i).collect()]
        first = written(best_of(_scan(tiled, own, True, positives, focus, band), ["a"], order, positives, salt)
                        .select("a", "other_id", "score"), "negatives-positives")
        bounds: dict[int, set[int]] = {}
        for r in first.where("score >= 0").select("a", "score").distinct().collect():
            bounds.setdefault(r.a, set()).add(r.score)
        asked = [(a, vec_id, label, v, sorted(bounds[a])) for a, vec_id, label, v, _ in own if a in bounds]
        second = written(best_of(_scan(tiled, asked, False, negatives, focus, band), ["a", "bound"], order, negatives,
                                 salt), "negatives-found")
        near = first if near is None else near.union(first)
        far = second if far is None else far.union(second)
    pairs = near.withColumnRenamed("score", "bound").withColumnRenamed("other_id", "positive_id")
    return pairs.join(far, ["a", "bound"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        F.col("bound").alias("positive_score"), F.col("score").alias("negative_score"))
