"""As-of joins by sort and fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import hot_key_rows, hot_keys


def latest_state(rows: DataFrame, states: DataFrame, key: str, time: str, state: str,
                 limit: int | None = None) -> DataFrame:
    """``rows`` with ``state``: that of the latest row of ``states`` with the same
    ``key`` whose ``time`` is at or before the row's; null when there is none.

    Both sides go into one table, sorted by key and time, and the last state is
    filled forward: no range join and no candidates per pair.  States at the same
    time come first, the greater state last.  A key of more than ``limit`` rows
    (``spark.kpiloom.hotKeyRows``) is split: its rows are dealt over salts by a hash,
    its states (few per key) repeated for each, so no window holds much more than
    ``limit`` of its rows.  A null key or time matches nothing; such rows are kept
    aside, with a null state.
    """
    limit = limit or hot_key_rows(rows.sparkSession)
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    found = hot_keys(rows.select(key), key, limit)
    hot_rows = found.collect()                                # at most rows / limit keys
    dealt = rows.where(usable).withColumn("_salt", F.lit(0))
    given = states.where(usable & F.col(state).isNotNull()).select(key, time, F.col(state).alias("_state"))
    spread = given.withColumn("_salt", F.lit(0))
    if hot_rows:
        hot = F.broadcast(rows.sparkSession.createDataFrame(hot_rows, found.schema))
        dealt = rows.where(usable).join(hot, key, "left").withColumn("_salt", F.coalesce(
            F.pmod(F.xxhash64(*rows.columns), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
        spread = given.join(hot, key, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    both = spread.withColumn("_row", F.lit(0)).unionByName(
        dealt.withColumns({"_row": F.lit(1), "_state": F.lit(None).cast(given.schema["_state"].dataType)}),
        allowMissingColumns=True)
    order = Window.partitionBy(key, "_salt").orderBy(time, "_row", "_state").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn(state, F.last("_state", ignorenulls=True).over(order)).where("_row = 1").select(
        *rows.columns, state)
    return filled.unionByName(rows.where(~usable).withColumn(
        state, F.lit(None).cast(given.schema["_state"].dataType)))
