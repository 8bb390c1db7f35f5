"""Embedding near-duplicates by collision counting on sorted projections.

Unit vectors are projected on many random directions.  Two vectors collide on a
direction when one lies in the window centred on the other; vectors at the cosine
threshold collide on each direction with a known probability, so a pair is verified
only if it collides often enough, a count calibrated to a recall.  The first few
directions deal the work out: their sorted axes are cut into cells no narrower than
the window, and only vectors of the same or neighbouring cells meet, the more
directions the more vectors there are.  Inside a pair of cells the vectors are sorted
along one more direction and meet inside its windows.
"""

from __future__ import annotations

import itertools
import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, scratch, written
from .components import connected_components
from .files import OnceFile, store
from .simhash import star_forest

#: Cosine of a link.
COSINE = 0.95
#: Projections, how many of them cut the space into cells at most, and the cells that an
#: axis has on average (vectors of the same number of components spread alike).
PROJECTIONS = 24
MOST_ROUTING = 8
CELLS_PER_AXIS = 5
#: Half window in standard deviations of the projected difference of a pair whose
#: cosine is the threshold; per projection it misses one pair in 2,100.
WINDOW = 3.5
#: Pairs at the threshold that pass the count, at least.
RECALL = 0.9999
#: Vectors in a tile, rows of a strip that share a window, and tile pairs of a task.
TILE = 1024
STRIP = 128
TASK_PAIRS = 512
#: Projections counted over all pairs of a window; the rest are counted over the pairs
#: that these leave.
FIRST = 12
SEED = 11


def calibrated_count(projections: int, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with the given
    probability when it collides independently on each projection."""
    p = math.erf(window / math.sqrt(2))
    kept = 0.0
    for count in range(projections, -1, -1):
        kept += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if kept >= recall:
            return count
    return 0


@lru_cache(32)
def directions(dim: int, n: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """n unit vectors of ``dim`` components; groups of ``dim`` of them are orthogonal,
    which makes their collisions as independent as they can be."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-n // dim))]
    return np.concatenate(blocks)[:n]


def half_window(dim: int, cosine: float, window: float) -> float:
    return window * math.sqrt(2 - 2 * cosine) / math.sqrt(dim)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def scaled_unit(x: np.ndarray) -> np.ndarray:
    """Unit rows, by way of their largest component: no square leaves the range of doubles."""
    return unit_rows(x / np.abs(x).max(axis=1, keepdims=True)) if len(x) else x


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows are (vec_id, key), key null for vectors that link with
    nothing; classes are (key, vector, copies, first_id), one per different vector."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    # 0.0 and -0.0 are one value; a 128-bit key of the exact components
    text = F.transform("v", lambda x: x + F.lit(0.0)).cast("string")
    rows = written(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.md5(text))), "vectors")
    found = rows.where("key is not null").groupBy("key").agg(
        F.any_value("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return rows.select("vec_id", "key"), written(
        found.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def routing_axes(n: int, tile: int = TILE) -> int:
    """Projections that cut the space for n vectors: as many as leave a cell about a tile."""
    return max(1, min(MOST_ROUTING, int(math.log(max(n / tile, 1)) / math.log(CELLS_PER_AXIS))))


def _tiles(found: DataFrame, folder: str, projections: int, cosine: float, window: float, routing: int,
           tile: int, kind: str) -> DataFrame:
    """Index (dim, cell, part, file, at, n) of tile files in ``folder``.  A tile holds about
    ``tile`` classes of one cell at most, sorted by their projection on the window axis:
    their nodes, copies and vectors, one array after the other."""
    def cell_of(batches):
        for b in batches:
            sizes = np.diff(np.asarray(b.column(1).offsets).astype(np.int64))
            flat = np.asarray(b.column(1).flatten(), np.float64)
            at = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                u = scaled_unit(x)
                lines = directions(dim, projections)
                width = half_window(dim, cosine, window) * (1 + 1e-9)
                c = np.floor(u @ lines[:min(routing, dim)].T / width).astype(np.int64)
                some = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(some), b.column(2).take(some), pa.array([dim] * len(rows), pa.int32()),
                     pa.array(list(c), pa.list_(pa.int64())),
                     pa.array(u @ lines[window_axis(dim, routing, projections)], pa.float64()),
                     pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())],
                    names=["node", "copies", "dim", "cell", "along", "data"])

    placed = written(found.select("node", "v", "copies").mapInArrow(
        cell_of, "node bigint, copies bigint, dim int, cell array<bigint>, along double, data binary"), "vector-cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / tile).alias("parts")).where("parts > 1")
    packed = placed.join(written(sizes, "cell-sizes"), ["dim", "cell"], "left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    rows = packed.groupBy("dim", "cell", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("along", "node", "copies", "data"))).alias("rows"))
    rows = rows.select("dim", "cell", "part", "rows.node", "rows.copies", "rows.data")

    def store_tiles(batches):
        out, at = OnceFile(folder, f"tiles-{uuid.uuid4().hex}"), 0
        for b in batches:
            places, counts = [], []
            for node, copies, data in zip(*(b.column(i) for i in (3, 4, 5))):
                held = (node.values.to_numpy().astype("<i8").tobytes() + copies.values.to_numpy().astype("<i8").tobytes()
                        + b"".join(data.as_py()))
                out.open().write(held)
                places.append(at)
                counts.append(len(node))
                at += len(held)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([out.name] * b.num_rows), pa.array(places, pa.int64()), pa.array(counts, pa.int64())],
                names=["dim", "cell", "part", "file", "at", "n"])
        out.close()

    return written(rows.mapInArrow(
        store_tiles, "dim int, cell array<bigint>, part bigint, file string, at bigint, n bigint"), "vector-tiles")


class TileReader:
    """Tiles of a folder by file and place, the last few kept."""

    def __init__(self, folder: str, kind: str, projections: int, held: int = 64):
        self.folder, self.kind, self.projections = folder, np.dtype(kind), projections
        self.fs, self.base = store(folder)
        self.file = lru_cache(8)(lambda name: self.fs.open_input_file(f"{self.base}/{name}"))
        self.tile = lru_cache(held)(self._tile)

    def _tile(self, name: str, at: int, n: int, dim: int):
        """(nodes, copies, unit vectors, projections by axis)."""
        f = self.file(name)
        f.seek(at)
        data = f.read(n * (16 + dim * self.kind.itemsize))
        u = scaled_unit(np.frombuffer(data, self.kind, n * dim, 16 * n).reshape(n, dim).astype(np.float64))
        return (np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), u,
                directions(dim, self.projections) @ u.T)


def window_axis(dim: int, routing: int, projections: int) -> int:
    """The projection that rows of a tile are sorted by: the first that cuts no cells."""
    return min(min(routing, dim), projections - 1)


def near_pairs(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool,
               half: float, count: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of a and b with enough collisions and cosine at or
    above ``cosine``.  pa_ and pb hold a row of each projection."""
    misses_allowed = len(pa_) - count
    first = min(FIRST, len(pa_))
    miss = np.zeros((a.shape[0], b.shape[0]), np.uint8)
    # in single precision, with a window wider than its rounding
    apart, wide = np.empty(miss.shape, np.float32), np.float32(half + 1e-6)
    for x, y in zip(pa_[:first].astype(np.float32), pb[:first].astype(np.float32)):
        np.subtract(x[:, None], y[None, :], out=apart)
        miss += np.abs(apart, out=apart) > wide
    i, j = np.nonzero(miss <= misses_allowed)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    missed = miss[i, j]
    for k in range(first, len(pa_)):            # the rest over pairs that can still pass
        if not len(i):
            break
        missed = missed + (np.abs(pa_[k][i] - pb[k][j]) > half)
        keep = missed <= misses_allowed
        i, j, missed = i[keep], j[keep], missed[keep]
    keep = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
    return i[keep], j[keep]


def windowed_pairs(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, axis: int,
                   half: float, count: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`near_pairs` of tiles that are sorted along ``axis``: a few rows of a at a
    time meet the rows of b inside their common window only."""
    u, v = [], []
    for i in range(0, len(a), STRIP):
        strip = slice(i, i + STRIP)
        low, high = np.searchsorted(pb[axis], (pa_[axis][strip][0] - half, pa_[axis][strip][-1] + half))
        low, high = max(low - 1, i if same else 0), high + 1        # rounding: a row more is harmless
        if low < high:
            x, y = near_pairs(a[strip], b[low:high], pa_[:, strip], pb[:, low:high], False, half, count, cosine)
            u.append(x + i)
            v.append(y + low)
    if not u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(u), np.concatenate(v)
    return (u[u < v], v[u < v]) if same else (u, v)


def link_classes(found: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS,
                 routing: int | None = None, window: float = WINDOW, recall: float = RECALL,
                 tile: int = TILE, kind: str = "<f8") -> DataFrame:
    """(src, dst, links) from the compared tile pairs: rows with dst are edges that
    connect the linked classes of a tile pair exactly as all its links do, one per
    class at most; rows without say how many vectors src links with there.

    Tiles are files in the shared folder, written once.  What is joined and dealt out
    are their places, a few dozen bytes a tile pair; a task reads the tiles it
    compares, each left one once.
    """
    spark = found.sparkSession
    bound_batches(spark)
    n = found.count()
    routing = routing_axes(n, tile) if routing is None else min(routing, projections)
    count = calibrated_count(projections, window, recall)
    folder = scratch(spark, "tiles")
    tiles = _tiles(found, folder, projections, cosine, window, routing, tile, kind)
    # a neighbouring cell differs by a step of -1, 0 or 1 on each axis; of a step and
    # its opposite one is enough
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=routing)), np.int64)
    steps = steps[len(steps) // 2:]
    step = F.explode(F.lit(steps.tolist()).cast("array<array<bigint>>"))
    left = tiles.select("dim", F.col("cell").alias("at_cell"), F.col("part").alias("lpart"), F.col("file").alias("lfile"),
                        F.col("at").alias("lat"), F.col("n").alias("ln"), step.alias("step"))
    # vectors of fewer components than axes have shorter cells: their other steps are 0
    short = F.exists(F.slice("step", F.size("at_cell") + 1, F.greatest(F.lit(routing) - F.size("at_cell"), F.lit(0))),
                     lambda x: x != 0)
    left = left.where(~short).withColumn("cell", F.transform("at_cell", lambda x, i: x + F.get("step", i)))
    own = F.col("at_cell") == F.col("cell")
    pairs = left.join(tiles, ["dim", "cell"]).where(~own | (F.col("lpart") <= F.col("part"))).select(
        "dim", "lfile", "lat", "ln", "file", "at", "n", (own & (F.col("lpart") == F.col("part"))).alias("same"))
    pairs = written(pairs, "tile-pairs")
    n_pairs = pairs.count()
    tasks = max(1, min(n_pairs, spark.sparkContext.defaultParallelism), n_pairs // TASK_PAIRS)
    dealt = pairs.repartition(tasks, "lfile", "lat").sortWithinPartitions("lfile", "lat", "file", "at")

    def compare(batches):
        tiles = TileReader(folder, kind, projections)
        for batch in batches:
            out = [[], [], []]
            for dim, lfile, lat, ln, file, at, n, same in zip(*(batch.column(i).to_pylist() for i in range(8))):
                na, ca, a, p = tiles.tile(lfile, lat, ln, dim)
                nb, cb, b, q = tiles.tile(file, at, n, dim)
                u, v = windowed_pairs(a, b, p, q, same, window_axis(dim, routing, projections),
                                      half_window(dim, cosine, window), count, cosine)
                if not len(u):
                    continue
                if same:
                    nodes, copies = na, ca
                else:
                    nodes, copies, v = np.concatenate([na, nb]), np.concatenate([ca, cb]), v + len(na)
                lab = star_forest([(u, v)], len(nodes))
                leaf = np.flatnonzero(lab != np.arange(len(nodes)))
                links = np.zeros(len(nodes), np.int64)
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                some = np.flatnonzero(links)
                out[0] += nodes[lab[leaf]].tolist() + nodes[some].tolist()
                out[1] += nodes[leaf].tolist() + [None] * len(some)
                out[2] += [None] * len(leaf) + links[some].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], names=["src", "dst", "links"])

    return dealt.mapInArrow(compare, "src bigint, dst bigint, links bigint")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    cosine: float = COSINE, **how) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id
    reachable by links, itself included), kept, for every row.

    Vectors that are null, empty, zero, or hold a null or non-finite component link
    with nothing and are their own component.  Equal vectors are one class, so
    their pairs are counted, never listed.  A row with a null id keeps its row: its
    component is the smallest id of the others, or null, and it is kept only when
    alone with a null component.  Rows that repeat an id share its component when
    linked.  Vectors of different lengths never link.  Other columns are ignored; an
    empty table gives no rows.
    """
    rows, found = classes(vectors, id_col, vector_col)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    links = written(link_classes(found, cosine, kind="<f4" if single else "<f8", **how), "vector-links")
    roots = connected_components(links.where("dst is not null").select("src", "dst"))
    direct = links.where("links is not null").groupBy(F.col("src").alias("node")).agg(
        F.sum("links").alias("links"))
    rooted = written(
        found.select("node", "key", "copies", "first_id")
        .join(roots, "node", "left").join(direct, "node", "left")
        .select("key", F.coalesce("component", "node").alias("root"), "first_id",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-roots")
    smallest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "vector-first")
    of_key = written(rooted.join(smallest, "root").select("key", "n_links", "component_id"), "vector-answers")
    return rows.join(of_key, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
