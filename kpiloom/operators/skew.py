"""Hot-key handling for joins of a large keyed table with a per-key lookup.

A user holding a third of all orders would put a third of the orders into one
join task.  AQE's skew join only rewrites joins whose both sides are plain
shuffles; a lookup side that comes out of an aggregate does not qualify.  So
hot keys are split explicitly:

1. count rows per key on a one-column projection of the source (partial
   aggregate; one row per key after the shuffle);
2. keep the keys with more than ``limit`` rows - by construction at most
   ``rows / limit`` keys, so broadcasting them is bounded;
3. big side: a hot key's rows get a salt in ``[0, ceil(n / limit))`` from a hash
   of the row; other rows get salt 0;
4. lookup side: a hot key's row is repeated once per salt (at most
   ``2 * rows / limit`` extra rows in total);
5. join on (key, salt).  Every join task then holds at most about ``limit``
   rows of one key, and the per-key aggregate that follows combines the salted
   pieces map-side.

Cost: one counting job over the key column when the join is built.  Its result, the
hot keys, is the size of rows / limit; without hot keys the join is a plain one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEY_ROWS_CONF = "spark.kpiloom.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 2_000_000


def hot_key_rows(spark) -> int:
    return int(spark.conf.get(HOT_KEY_ROWS_CONF, str(DEFAULT_HOT_KEY_ROWS)))


def hot_keys(keys: DataFrame, key: str, limit: int) -> DataFrame:
    """``(key, _salts)`` for keys with more than ``limit`` rows."""
    counts = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.filter(F.col(key).isNotNull() & (F.col("_n") > limit))
            .select(key, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_salts")))


def salted_key_join(big: DataFrame, lookup: DataFrame, key: str, counts_from: DataFrame,
                    how: str = "inner", limit: int | None = None) -> DataFrame:
    """``big`` joined to ``lookup`` (few rows per key) on ``key`` with hot keys
    split as described above.  ``counts_from`` is a cheap projection holding
    one row per ``big`` row (e.g. the source table's key column), so the
    counting pass does not recompute ``big``."""
    limit = limit or hot_key_rows(big.sparkSession)
    if how in ("inner", "right", "right_outer", "rightouter"):
        big = big.filter(F.col(key).isNotNull())      # cannot match; kept out of the shuffle
    found = hot_keys(counts_from.select(key), key, limit)
    hot_rows = found.collect()                        # <= rows / limit keys
    if not hot_rows:
        return big.join(lookup.hint("merge"), key, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(hot_rows, found.schema))
    b = big.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(*big.columns), F.col("_salts"))).cast("int")).drop("_salts")
    s = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return b.join(s.hint("merge"), [key, "_salt"], how).drop("_salt")


def left_join_nulls_aside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` where left rows with a null key skip
    the shuffle: they can never match, and kept in the join they would all hash
    to one partition (a null key holding a third of the rows is one hot task).
    They are unioned back with the right side's columns null."""
    matched = left.filter(F.col(key).isNotNull()).join(right, key, "left")
    return matched.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
