"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints that differ in at most ``radius`` bits have population counts that
differ by at most ``radius``, over the whole word and summed over any lanes of it.
Distinct fingerprints are packed into tiles of equal lane counts; only tile pairs
whose lane counts differ by ``radius`` or less in total meet, in an equi-join on
the count vector, and are compared exactly with numpy exclusive-or and bit counts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bound_batches, written
from .components import connected_components

#: Most fingerprints in a tile (two tiles make one comparison unit).
TILE = 4096
#: Most cells of the comparison matrix held at once.
CELLS = 1 << 20
#: Distinct fingerprints beyond which counts are taken over 8 lanes instead of 4.
WIDE = 1 << 25
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(data: bytes, k: int, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every k-word shingle of ``data``, in arrays; long texts
    go through in pieces of about ``chunk`` bytes, cut at white space."""
    low = data.lower()          # bytes: changes A-Z only
    carry: list[bytes] = []
    at, n, some = 0, len(low), False
    while at < n:
        end = at + chunk
        if end < n:
            gap = _SPACE.search(low, end)
            end = gap.start() if gap else n
        words = carry + (low[at:end] if at or end < n else low).split()
        at = end
        m = len(words) - k + 1
        if m > 0:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            a, z = (ends - size)[:m].tolist(), ends[k - 1:].tolist()
            yield np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, z)], np.uint64)
            some, carry = True, words[m:]
        else:
            carry = words
    if not some and carry:
        yield np.array([xxh64_intdigest(b" ".join(carry), 42)], np.uint64)


def fingerprint(data: bytes | None, k: int = 3) -> int:
    """The 64-bit SimHash as a signed long; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(data or b"", k):
        for i in range(0, len(h), 1 << 16):
            part = h[i:i + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp long) of every row; null and wordless texts give 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def compute(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"id {kind}, fp bigint")


def lane_counts(fp, lanes: int):
    """The population count of each lane of ``fp``, packed into one long."""
    width = 64 // lanes
    mask = (1 << width) - 1
    key = F.lit(0).cast("long")
    for i in range(lanes):
        lane = F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask).cast("long")) if lanes > 1 else fp
        key = key + F.shiftleft(F.bit_count(lane).cast("long"), 8 * i)
    return key


def lane_offsets(lanes: int, radius: int) -> list[int]:
    """Packed differences of lane counts that sum to ``radius`` or less in absolute
    value, one of each opposite pair."""
    out = set()
    for n in range(radius + 1):
        for places in itertools.combinations_with_replacement(range(lanes), n):
            for signs in itertools.product((1, -1), repeat=n):
                out.add(sum(s << (8 * p) for p, s in zip(places, signs)))
    return sorted(x for x in out if x >= 0)


def star_forest(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each of n nodes the smallest node connected with it."""
    lab = np.arange(n)
    while pairs:
        before = lab.copy()
        for u, v in pairs:
            m = np.minimum(lab[u], lab[v])
            np.minimum.at(lab, u, m)
            np.minimum.at(lab, v, m)
        lab = lab[lab]
        if np.array_equal(lab, before):
            break
    return lab


def linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the fingerprints of two tiles exactly as all their links
    of ``radius`` bits or fewer do, but at most one per fingerprint."""
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // max(1, len(b)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i:i + step, None] ^ b[None, :]) <= radius
        u, v = np.nonzero(near)
        u, v = u + i, v + shift
        keep = u < v if same else slice(None)
        u, v = u[keep], v[keep]
        if len(u) > len(nodes):       # dense: reduce at once, so memory stays bounded
            lab = star_forest([(u, v)], len(nodes))
            v = np.flatnonzero(lab != np.arange(len(nodes)))
            u = lab[v]
        if len(u):
            found.append((u, v))
    lab = star_forest(found, len(nodes))
    v = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[lab[v]], nodes[v]


def link_fingerprints(fps: DataFrame, radius: int = 2, tile: int = TILE,
                      lanes: int | None = None) -> DataFrame:
    """Edges (src, dst) that connect distinct ``fp`` values exactly as the links of
    ``radius`` or fewer differing bits do (bounded by one edge per fingerprint and
    tile pair, so a large group of near copies does not emit all its pairs)."""
    spark = fps.sparkSession
    bound_batches(spark)
    distinct = written(fps.select("fp").distinct(), "fingerprints")
    lanes = lanes or (4 if distinct.count() < WIDE else 8)
    keyed = distinct.withColumn("key", lane_counts(F.col("fp"), lanes))
    large = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    tiles = written(
        keyed.join(written(large, "tile-counts"), "key", "left")
        .groupBy("key", F.pmod(F.xxhash64("fp"), parts).alias("part"))
        .agg(F.collect_list("fp").alias("fps")), "tiles")
    offsets = F.array(*[F.lit(x).cast("long") for x in lane_offsets(lanes, radius)])
    left = tiles.select((F.col("key")).alias("lkey"), F.col("part").alias("lpart"),
                        F.col("fps").alias("lfps"), F.explode(offsets).alias("step"))
    left = left.withColumn("key", F.col("lkey") + F.col("step"))
    pairs = left.join(tiles, "key").where("step > 0 or lpart <= part").select(
        ((F.col("step") == 0) & (F.col("lpart") == F.col("part"))).alias("same"), "lfps", "fps")

    def compare(batches):
        for batch in batches:
            same = batch.column(0).to_pylist()
            sides = []
            for c in (1, 2):
                col = batch.column(c)
                at = col.offsets.to_numpy()
                sides.append((col.values.to_numpy(zero_copy_only=False).view(np.uint64), at))
            (x, xa), (y, ya) = sides
            out = [linked(x[xa[i]:xa[i + 1]], y[ya[i]:ya[i + 1]], s, radius)
                   for i, s in enumerate(same)]
            out = [o for o in out if len(o[0])]
            u = np.concatenate([o[0] for o in out]) if out else np.empty(0, np.uint64)
            v = np.concatenate([o[1] for o in out]) if out else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["src", "dst"])

    return pairs.mapInArrow(compare, "src bigint, dst bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component) of every row of ``docs``.

    ``component`` is the smallest non-null id among all rows reachable by links of
    ``radius`` or fewer differing bits (equal fingerprints included).  Null, empty
    and wordless texts have fingerprint 0 and are linked like any other.  Repeated
    rows each keep their row; null ids keep their row and take the component of
    the others in their group (null when all its ids are null).  Other columns
    of ``docs`` are ignored, so their names cannot clash.  An empty table gives
    no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    per_fp = written(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "fp-first")
    labels = connected_components(link_fingerprints(per_fp, radius))
    rooted = written(
        per_fp.join(labels.select(F.col("node").alias("fp"), F.col("component").alias("root")),
                    "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"), "fp-roots")
    smallest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component")), "roots")
    of_fp = written(rooted.join(smallest, "root").select("fp", "component"), "fp-components")
    return fps.join(of_fp, "fp").select("id", "fp", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (null ids
    last; of rows that repeat an id, one).  All columns stay as they are."""
    own = docs.columns
    h = "__text_hash"
    while h in own:
        h += "_"
    hashed = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    rows = fingerprints(
        hashed.select(F.struct(F.col(id_col).alias("i"), F.col(h).alias("h")).alias("key"), text_col),
        "key", text_col, shingle)
    fps = written(rows.select(F.col("id.i").alias("i"), F.col("id.h").alias("h"), "fp"), "simhash")
    # the first row of each fingerprint, then of each component, by (null last, id, hash)
    order = F.struct(F.col("i").isNull().alias("n"), F.col("i").alias("i"), F.col("h").alias("h"))
    per_fp = written(fps.groupBy("fp").agg(F.min(order).alias("first")), "fp-first")
    labels = connected_components(link_fingerprints(per_fp, radius))
    keep = written(
        per_fp.join(labels.select(F.col("node").alias("fp"), F.col("component").alias("root")),
                    "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.i").alias("__i"), F.col("first.h").alias("__h")).distinct(), "keep")
    out = hashed.join(
        keep, hashed[id_col].eqNullSafe(keep["__i"]) & (hashed[h] == keep["__h"]), "left_semi")
    repeated = fps.groupBy("i", "h").count().where("count > 1").select(
        F.col("i").alias("__i"), F.col("h").alias("__h"))
    if not repeated.join(
            keep.withColumnsRenamed({"__i": "k", "__h": "kh"}),
            F.col("__i").eqNullSafe(F.col("k")) & (F.col("__h") == F.col("kh")),
            "left_semi").isEmpty():
        out = out.dropDuplicates([id_col, h])
    return out.select(*[out[c] for c in own])
