"""Byte-balanced sharding by histogram sort, DataFrame functions only.

Rows are ordered by (hash of the text, hash of id and text).  Splitters of that
order are found without moving rows: each round counts, in one aggregate over all
partitions, the exact bytes in the key cells around every unsettled splitter, and
divides the cell a target falls into further, until the bytes below an edge are
within tolerance of the target.  Rows are exchanged once, to their final shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of the key that one probing round resolves: 4,096 probes per splitter.
BITS = 12
_LOW = -(1 << 63)


@dataclass(frozen=True)
class Splitter:
    """First key of the next shard: rows with (h, t) at or above it belong there."""

    h: int
    t: int
    below: int      # exact bytes below it
    target: float


@dataclass(frozen=True)
class _Open:
    """A target that lies in the key cell ``prefix`` of ``bits`` leading bits: of h,
    or of t among the rows whose h is ``group``; ``before`` bytes lie below it."""

    target: float
    prefix: int = 0
    bits: int = 0
    before: int = 0
    group: int | None = None


def _cell(key: str, bits: int) -> Column:
    """The leading ``bits`` of a signed long, 0 for the smallest values."""
    flipped = F.col(key).bitwiseXOR(F.lit(_LOW).cast("long"))
    if bits == 64:
        return F.col(key)                           # compared as a signed long
    return F.shiftrightunsigned(flipped, 64 - bits)


def _edge(cell: int, bits: int) -> int:
    """Smallest signed key of a cell; one past the last key stays a Python int."""
    return cell if bits == 64 else (cell << (64 - bits)) + _LOW


def _prefix(cell: int, bits: int, shift: int) -> int:
    return (cell - _LOW if bits == 64 else cell) >> shift


def _probe(keys: DataFrame, near: list[_Open]) -> dict:
    """Exact bytes of each cell one round deeper than ``near`` (all at one depth)."""
    bits, grouped = near[0].bits, near[0].group is not None
    deeper = min(bits + BITS, 64)
    key, rows = ("t", keys) if grouped else ("h", keys)
    if grouped:
        rows = rows.where(F.col("h").isin(sorted({o.group for o in near})))
    if bits:
        rows = rows.where(_cell(key, bits).isin(sorted({o.prefix for o in near})))
    by = [_cell(key, deeper).alias("cell")] + ([F.col("h").alias("g")] if grouped else [])
    out: dict = {}
    for r in rows.groupBy(*by).agg(F.sum("size").alias("bytes")).collect():
        at = (r["g"] if grouped else None, _prefix(r["cell"], deeper, deeper - bits))
        out.setdefault(at, []).append((r["cell"], r["bytes"]))
    return out


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """Splitters of the (h, t, size) rows into ``shards`` parts of equal bytes.

    ``tolerance`` is the allowed distance from a target as a share of one part.
    The driver sees at most 2 ** BITS counts per unsettled splitter and round.
    An edge between different texts is taken when one is near enough; only a group
    of equal texts larger than the tolerance is cut, by the second hash.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    allowed = tolerance * total / shards
    settled: list[Splitter] = []
    waiting = [_Open(total * i / shards) for i in range(1, shards)]
    while waiting:
        depth = (waiting[0].group is not None, waiting[0].bits)
        near = [o for o in waiting if (o.group is not None, o.bits) == depth]
        waiting = [o for o in waiting if o not in near]
        counts, step = _probe(keys, near), min(depth[1] + BITS, 64)
        for o in near:
            below, best, inside = o.before, None, None
            for cell, size in sorted(counts.get((o.group, o.prefix), [])):
                for edge, at in ((cell, below), (cell + 1, below + size)):
                    if best is None or abs(at - o.target) < abs(best[1] - o.target):
                        best = (edge, at)
                if below <= o.target < below + size:
                    inside = (cell, below)
                below += size
            if best is None:                                    # an empty table
                settled.append(Splitter(_LOW, _LOW, 0, o.target))
            elif abs(best[1] - o.target) <= allowed or inside is None or (depth[0] and step == 64):
                edge = _edge(best[0], step)
                h, t = (o.group, edge) if depth[0] else (edge, _LOW)
                settled.append(Splitter(h, t, best[1], o.target))
            elif step == 64:                                    # one text hash holds the target
                waiting.append(_Open(o.target, before=inside[1], group=inside[0]))
            else:
                waiting.append(_Open(o.target, inside[0], step, inside[1], o.group))
    return sorted(settled, key=lambda s: s.target)


def shard_of(splitters: list[Splitter], hash_col: str = "h", tie_col: str = "t") -> Column:
    """The shard of a row by its two hashes: how many splitters are at or below."""
    top = (1 << 63) - 1
    shard = F.lit(0)
    for s in splitters:
        if s.h > top:
            continue                                            # above every key
        h, t = F.lit(s.h).cast("long"), F.lit(min(s.t, top)).cast("long")
        if s.t == _LOW:
            above = F.col(hash_col) >= h
        elif s.t > top:
            above = F.col(hash_col) > h
        else:
            above = (F.col(hash_col) > h) | ((F.col(hash_col) == h) & (F.col(tie_col) >= t))
        shard = shard + above.cast("int")
    return shard


def histogram_shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id",
                    text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text, none if null, plus 1),
    ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (gapless from 0 in each shard).

    Equal texts are neighbours in the key order, so a group of copies is cut only
    where a target falls inside it and it exceeds the tolerance.  Rows that agree in
    id and text cannot be told apart and stay in one shard.  Null ids and texts are
    ordinary keys; an empty table gives no rows.  A column of ``docs`` named size,
    shard or slot is replaced.  Unselected columns never reach the exchange.
    """
    text, ident = F.col(text_col).cast("string"), F.col(id_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    h, t = F.xxhash64(text), F.xxhash64(ident, text)
    keys = written(docs.select(h.alias("h"), t.alias("t"), size.alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    # a shard is numbered in two levels, hashed cells and rows of a cell, neither of which
    # holds more than about the square root of the shard's rows in one task
    cells = max(1, math.isqrt(keys.count() // shards))
    shard = shard_of(splitters)
    cell = F.pmod(F.xxhash64("t"), F.lit(cells))
    # rows below each (shard, cell): one row per sort cell
    per_cell = written(keys.groupBy(shard.alias("__shard"), cell.alias("__cell"))
                       .agg(F.count("*").alias("n")), "shard-cells")
    below = per_cell.select("__shard", "__cell", (
        F.sum("n").over(Window.partitionBy("__shard").orderBy("__cell")) - F.col("n")).alias("__below"))
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    placed = (docs.select(*[F.col(f"`{c}`") for c in own], size.alias("size"),
                          h.alias("__h"), t.alias("__t"))
              .withColumns({"__shard": shard_of(splitters, "__h", "__t"),
                            "__cell": F.pmod(F.xxhash64("__t"), F.lit(cells))}))
    place = F.row_number().over(
        Window.partitionBy("__shard", "__cell").orderBy("__h", "__t")) - 1
    return (placed.withColumn("__place", place)
            .join(below, ["__shard", "__cell"])
            .select(*[F.col(f"`{c}`") for c in own], "size", F.col("__shard").alias("shard"),
                    (F.col("__below") + F.col("__place")).cast("long").alias("slot")))
