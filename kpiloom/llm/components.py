"""Connected components of an undirected edge table, by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src long, dst long).

    ``component`` is one node of the component (the callers take the smallest
    document id over it).  Each round points every node at the neighbour, or
    itself, that comes first in a hash order of that round, replaces nodes by the
    ones pointed at, and drops loops and repeats; the number of nodes falls by a
    constant factor on average, so rounds grow with the logarithm of the largest
    component.  Pointers are composed backwards at the end.

    A hub node costs no hot task: its neighbours are reduced by a partial
    aggregate, and the pointer joins read written tables on both sides, which
    lets adaptive execution split a skewed key.  Self loops, repeated and
    reversed edges and null ends are ignored; no edges give no rows.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    left = written(clean, "edges")
    pointers: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(pointers))
        both = left.union(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = both.groupBy(F.col("src").alias("node")).agg(
            F.min_by("dst", F.xxhash64("dst", seed)).alias("near"))
        to = written(first.select(
            "node", F.when(F.xxhash64("near", seed) < F.xxhash64("node", seed), F.col("near"))
            .otherwise(F.col("node")).alias("to")), "pointers")
        pointers.append(to)
        moved = (left
                 .join(to.select(F.col("node").alias("src"), F.col("to").alias("a")), "src")
                 .join(to.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
                 .where("a <> b")
                 .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
                 .distinct())
        left = written(moved, "edges")
    if not pointers:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    label = pointers[-1].select("node", F.col("to").alias("component"))
    for to in reversed(pointers[:-1]):
        label = written(
            to.join(label.select(F.col("node").alias("to"), "component"), "to", "left")
            .select("node", F.coalesce("component", "to").alias("component")), "labels")
    return label
