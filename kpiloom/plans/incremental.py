"""Gold kept up to date from batches, recomputing only the days a batch touches.

A batch of new rows is reduced to mergeable partial states: order states (rows and
completed rows per order), item states (count, exact sum, rest per order) and activity
states (events and newest time per user and day).  They are written as Parquet under
``<table>/part=<day>/batch=<id>``, where a dynamic partition overwrite replaces what an
interrupted attempt of the same batch may have left.  A day's gold is a merge of the
states of its partitions, so batches may come in any order, and late; a batch that the
ledger names has been applied and is skipped.

Items carry no day.  They are filed under the day of their order, looked up in the
newest days first; items that come before their order wait in ``part=pending``, which
every touched day reads along.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import money_sum, rest_sum, units_to_double, zero_units
from ..operators.retention import retention_weekly
from ..operators.revenue import COMPLETE
from ..session import scratch_path
from ..sources.artifacts import _exists

#: States of rows without a time, and of items that wait for their order.
NO_DAY, PENDING = "none", "pending"
#: Days behind the newest that items are looked up in first.
RECENT_DAYS = 35

_PART = "part string, batch string"
STATES = {
    "orders": f"order_id long, n_rows long, n_complete long, {_PART}",
    "items": f"order_id long, n_items long, price_sum long, price_rest double, {_PART}",
    "activity": f"user_id long, n_events long, last_ts timestamp_ntz, {_PART}",
}
GOLD = {
    "revenue_daily": "orders long, revenue_units long, revenue_rest double, part string",
    "activity_daily": "events long, active_users long, part string",
}
LEDGER = "batch string, table_name string, rows long, late_rows long, newest string"


def part_of(ts: Column) -> Column:
    """The partition of a time: its day as text."""
    return F.coalesce(ts.cast("date").cast("string"), F.lit(NO_DAY))


class IncrementalGold:
    """Gold models of a folder on shared storage, fed by batches.

    An order id belongs to one day: its rows, in whatever batch, share ``created_at``'s
    day.  Batches are applied one at a time (one writer per folder).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- storage --------------------------------------------------------------

    def _read(self, name: str, schema: str, parts: list[str] | None = None) -> DataFrame:
        """A table, or its given partitions only (a partition filter: no other file is opened)."""
        path = f"{self.folder}/{name}"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(path)
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def state(self, name: str, parts: list[str] | None = None) -> DataFrame:
        return self._read(f"state/{name}", STATES[name], parts)

    def gold(self, name: str, parts: list[str] | None = None) -> DataFrame:
        return self._read(f"gold/{name}", GOLD[name], parts)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def _overwrite(self, df: DataFrame, path: str, *by: str) -> None:
        # rebalanced by day: small days share a task, a large one is split, few files each
        df.hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(
            f"{self.folder}/{path}")

    def _file(self, df: DataFrame, name: str, batch: str) -> DataFrame:
        """Write a batch's states; returns them from the files."""
        self._overwrite(df.withColumn("batch", F.lit(batch)), f"state/{name}", "part", "batch")
        return self.state(name).where(F.col("batch") == batch)

    # -- batches --------------------------------------------------------------

    def apply(self, batch: str, orders: DataFrame | None = None, items: DataFrame | None = None,
              events: DataFrame | None = None, complete: str = COMPLETE) -> list[str]:
        """Apply a batch of new rows; returns the days whose gold was recomputed.

        ``batch`` names its content: a second call with the same name does nothing.  A
        row is late when its day is before the newest day applied so far (the
        high-water mark); late rows are counted in the ledger and treated like any.
        """
        past = self.ledger()
        if not past.where(F.col("batch") == batch).isEmpty():
            return []
        marks = {r["table_name"]: r["newest"] for r in past.groupBy("table_name").agg(
            F.max("newest").alias("newest")).collect()}
        touched: dict[str, set[str]] = {"revenue_daily": set(), "activity_daily": set()}
        applied: list[tuple] = []

        def file_orders_and_items() -> None:             # items are placed by the batch's orders
            if orders is not None:
                file_orders()
            if items is not None:
                file_items()

        def file_orders() -> None:
            rows = orders.groupBy("order_id", part_of(F.col("created_at")).alias("part")).agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("status") == complete).alias("n_complete"))
            filed = self._file(rows, "orders", batch)
            touched["revenue_daily"] |= self._counted(filed, "orders", "n_rows", batch, marks, applied)

        def file_items() -> None:
            per_order = items.groupBy("order_id").agg(
                F.count(F.lit(1)).alias("n_items"), money_sum("sale_price").alias("price_sum"),
                rest_sum("sale_price").alias("price_rest"))
            filed = self._file(self._placed(per_order, marks.get("orders")), "items", batch)
            touched["revenue_daily"] |= self._counted(filed, "items", "n_items", batch, {}, applied)

        def file_events() -> None:
            if events is None:
                return
            rows = events.groupBy("user_id", part_of(F.col("created_at")).alias("part")).agg(
                F.count(F.lit(1)).alias("n_events"), F.max("created_at").alias("last_ts"))
            filed = self._file(rows, "activity", batch)
            touched["activity_daily"] |= self._counted(filed, "activity", "n_events", batch, marks, applied)

        def merge(name: str) -> None:
            if touched[name]:
                self._overwrite(getattr(self, f"_{name}")(sorted(touched[name])), f"gold/{name}", "part")

        def revenue() -> None:
            file_orders_and_items()
            touched["revenue_daily"].discard(PENDING)
            merge("revenue_daily")

        def activity() -> None:
            file_events()
            merge("activity_daily")

        # the two models share no table: their jobs fill the cluster together
        with ThreadPoolExecutor(2) as pool:
            for done in [pool.submit(revenue), pool.submit(activity)]:
                done.result()
        # last: a batch that fails on the way is not in the ledger, and is applied again
        self.spark.createDataFrame(applied, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        return sorted(set().union(*touched.values()))

    def _counted(self, filed: DataFrame, name: str, count: str, batch: str, marks: dict, applied: list) -> set[str]:
        """Note a batch's rows in ``applied``; its partitions (one row per day)."""
        by_part = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.sum(count).alias("n")).collect()}
        days = [p for p in by_part if p not in (NO_DAY, PENDING)]
        mark = marks.get(name)
        late = sum(by_part[p] for p in days if mark is not None and p < mark)
        applied.append((batch, name, sum(by_part.values()), late, max(days, default=None)))
        return set(by_part)

    def _placed(self, per_order: DataFrame, mark: str | None) -> DataFrame:
        """Item states with the partition of their order, ``PENDING`` without one."""
        known = self.state("orders").select("order_id", "part")
        per_order = per_order.where(F.col("order_id").isNotNull())     # they can join no order
        if mark is not None:
            since = F.date_sub(F.lit(mark).cast("date"), RECENT_DAYS).cast("string")
            near = F.col("part") >= since
            path = scratch_path(self.spark, f"incremental/{uuid.uuid4().hex}")
            per_order.join(known.where(near).distinct(), "order_id", "left").write.parquet(path)
            first = self.spark.read.parquet(path)
            rest = first.where("part is null").drop("part")
            if rest.isEmpty():
                return first
            older = known.where(~near).distinct()
            return first.where("part is not null").unionByName(
                rest.join(older, "order_id", "left").withColumn("part", F.coalesce("part", F.lit(PENDING))))
        return per_order.join(known.distinct(), "order_id", "left").withColumn(
            "part", F.coalesce("part", F.lit(PENDING)))

    # -- merges ---------------------------------------------------------------

    def _revenue_daily(self, parts: list[str]) -> DataFrame:
        orders = self.state("orders", parts).groupBy("part", "order_id").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_complete").alias("n_complete"))
        filed = self.state("items", [*parts, PENDING])
        waiting = filed.where(F.col("part") == PENDING).drop("part").join(orders.select("part", "order_id"), "order_id")
        items = filed.where(F.col("part") != PENDING).unionByName(waiting).groupBy("part", "order_id").agg(
            F.sum("n_items").alias("n_items"), F.sum("price_sum").alias("price_sum"), F.sum("price_rest").alias("price_rest"))
        done = F.col("n_complete") > 0
        some_open = F.col("n_complete") < F.col("n_rows")
        units = F.when(done, F.col("n_complete") * F.col("price_sum"))
        return orders.join(items, ["part", "order_id"]).groupBy("part").agg(
            F.sum(F.col("n_complete") * F.col("n_items")).alias("orders"),
            F.sum(F.when(some_open, F.coalesce(units, zero_units())).otherwise(units)).alias("revenue_units"),
            F.sum(F.when(done, F.col("n_complete") * F.col("price_rest"))).alias("revenue_rest"))

    def _activity_daily(self, parts: list[str]) -> DataFrame:
        per_user = self.state("activity", parts).groupBy("part", "user_id").agg(F.sum("n_events").alias("n"))
        return per_user.groupBy("part").agg(F.sum("n").alias("events"), F.count("user_id").alias("active_users"))

    # -- models ---------------------------------------------------------------

    @staticmethod
    def _day() -> Column:
        return F.when(F.col("part") != NO_DAY, F.col("part")).cast("date").alias("day")

    def revenue_daily(self) -> DataFrame:
        """As :func:`kpiloom.operators.revenue.revenue_daily` over all batches."""
        amount = units_to_double("revenue_units", "revenue_rest")
        return self.gold("revenue_daily").select(
            self._day(), "orders", amount.alias("revenue"),
            F.try_divide(amount, F.nullif(F.col("orders"), F.lit(0))).alias("aov"))

    def activity_daily(self) -> DataFrame:
        """``(day, events, active_users)``: events, and distinct users with one."""
        return self.gold("activity_daily").select(self._day(), "events", "active_users")

    def last_event(self) -> DataFrame:
        """As :func:`kpiloom.operators.features.last_event`, from one row per user and day."""
        return self.state("activity").groupBy("user_id").agg(F.max("last_ts").alias("anchor_ts"))

    def retention_weekly(self, users: DataFrame) -> DataFrame:
        """As :func:`kpiloom.operators.retention.retention_weekly`, from one row per user and day."""
        active = self.state("activity").where(F.col("part") != NO_DAY).select(
            "user_id", F.col("part").cast("date").cast("timestamp_ntz").alias("created_at"))
        return retention_weekly(users, active)
