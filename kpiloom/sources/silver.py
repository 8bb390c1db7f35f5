"""Silver layer: the four e-commerce sources (users, orders, order_items, events)
derived from the driver's star-schema tables.

The driver tables carry no signup time, and order dates do not overlap event
dates, so some columns are deterministic stand-ins.  Every rule is a projection,
so the adapter fuses into the Parquet scan stage (no shuffle, codegen'd) and
filters on its outputs still push down to the scan where Catalyst can invert them.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas
from .tables import read_table

# ---------------------------------------------------------------------------
# Fixed values of the adapter (must be identical in the DuckDB oracles).
# ---------------------------------------------------------------------------
SIGNUP_BASE = _dt.date(2023, 10, 2)        # users.created_at = base + (id*37 mod 120) days
SIGNUP_MULT = 37
SIGNUP_SPAN = 120
ORDER_EPOCH = _dt.date(1995, 1, 1)         # orders.created_at = base + (days since epoch mod 90)
ORDER_BASE = _dt.date(2023, 12, 1)
ORDER_SPAN = 90
COMPLETE_EVERY = 7                          # status F and order_id mod 7 = 0 -> Complete
STATUS_BY_CODE = {"O": "Processing", "P": "Shipped"}   # other F -> Returned
PAGE_VIEW_MIN_VALUE = 40.0                  # view with value >= 40 -> page_view
ADD_TO_CART_MIN_VALUE = 100.0               # click with value >= 100 -> add_to_cart
TRAFFIC_SOURCES = ["Email", "Direct", "Organic", "Ads", "Social", "Other"]  # [k mod 6]
# First-generation funnel step names, applied to the untouched event type.
FIRST_GEN_STEPS = {"saw_landing": "view", "saw_product": "click", "saw_cart": "signup"}


def _days_after(base: _dt.date, days: Column) -> Column:
    """``base + days`` as a midnight ``timestamp_ntz`` (zone-free)."""
    return F.date_add(F.lit(base), days.cast("int")).cast("timestamp_ntz")


def _others(df: DataFrame, *mapped: str) -> list[str]:
    """The source columns that are not mapped to a silver column; they pass through, and
    a query that does not name them does not read them."""
    return [c for c in df.columns if c not in mapped]


def users_from_customer(customer: DataFrame) -> DataFrame:
    cid = F.col("c_custkey")
    return customer.select(
        cid.alias("id"),
        _days_after(SIGNUP_BASE, F.pmod(cid * SIGNUP_MULT, F.lit(SIGNUP_SPAN))).alias("created_at"),
        *_others(customer, "c_custkey"),
    )


def orders_from_orders(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    code = F.col("o_orderstatus")
    status = (
        F.when((code == "F") & (F.pmod(key, F.lit(COMPLETE_EVERY)) == 0), "Complete")
        .when(code == "F", "Returned")
        .when(code == "O", STATUS_BY_CODE["O"])
        .when(code == "P", STATUS_BY_CODE["P"])
    )
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit(ORDER_EPOCH))
    return orders.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        _days_after(ORDER_BASE, F.pmod(days, F.lit(ORDER_SPAN))).alias("created_at"),
        *_others(orders, "o_orderkey", "o_custkey"),
    )


def items_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_extendedprice").alias("sale_price"),
        *_others(lineitem, "l_orderkey", "l_extendedprice"),
    )


def events_from_events(events: DataFrame) -> DataFrame:
    raw = F.col("event_type")
    value = F.col("value")
    mapped = (
        F.when((raw == "view") & (value >= PAGE_VIEW_MIN_VALUE), "page_view")
        .when((raw == "click") & (value >= ADD_TO_CART_MIN_VALUE), "add_to_cart")
        .otherwise(raw)
    )
    k = F.get_json_object(F.col("props"), "$.k").try_cast("bigint")
    sources = F.array(*[F.lit(s) for s in TRAFFIC_SOURCES])
    source = F.try_element_at(sources, (F.pmod(k, F.lit(len(TRAFFIC_SOURCES))) + 1).cast("int"))
    return events.select(
        F.col("user_id"),
        mapped.alias("event_type"),
        raw.alias("raw_event_type"),
        F.col("ts").alias("created_at"),
        source.alias("traffic_source"),
        *_others(events, "user_id", "event_type", "ts"),
    )


# -- S2..S5: one function per silver table, reading the driver's parquet ------

def silver_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users_from_customer(read_table(spark, sf_dir, "customer"))


def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_from_orders(read_table(spark, sf_dir, "orders"))


def silver_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_from_lineitem(read_table(spark, sf_dir, "lineitem"))


def silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_events(read_table(spark, sf_dir, "events"))


def _as_declared(df: DataFrame, field) -> F.Column:
    c = F.col(field.name)
    have = df.schema[field.name].dataType
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(have, T.TimestampType):
        # an instant -> its UTC wall-clock time (the models work in UTC), whatever
        # the session time zone is
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        return F.to_utc_timestamp(c, zone).cast("timestamp_ntz").alias(field.name)
    return c.cast(field.dataType).alias(field.name)


def conform(df: DataFrame, schema, name: str) -> DataFrame:
    """A source table with the declared columns in their declared types first (S1: the
    declared source schema) and all its other columns after them.  A missing column raises with the table and column named;
    session-zone timestamps become UTC wall-clock ``timestamp_ntz``."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"source table {name} lacks column(s) {missing}")
    return df.select(*[_as_declared(df, f) for f in schema.fields], *_others(df, *schema.fieldNames()))


class Sources:
    """The four silver tables of one data directory; each is opened on first
    use only, so a report touches just the tables it reads.

    ``Sources.from_tables`` serves real e-commerce tables (names or DataFrames)
    instead of the driver's star schema.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.given = False          # tables handed over, not read from ``sf_dir``

    @classmethod
    def from_tables(cls, spark: SparkSession, users, orders, order_items, events, name: str = "tables") -> Sources:
        """Sources from catalog table names or DataFrames with the columns the
        models read: users(id, created_at), orders(order_id, user_id, status,
        created_at), order_items(order_id, sale_price), events(user_id,
        event_type, created_at, traffic_source)."""
        def frame(t):
            return spark.table(t) if isinstance(t, str) else t
        ev = frame(events)
        if "raw_event_type" not in ev.columns:
            ev = ev.withColumn("raw_event_type", F.col("event_type"))
        src = cls(spark, name)
        src.given = True
        src.__dict__.update(
            users=conform(frame(users), schemas.USERS, "users"),
            orders=conform(frame(orders), schemas.SILVER_ORDERS, "orders"),
            items=conform(frame(order_items), schemas.ORDER_ITEMS, "order_items"),
            events=conform(ev, schemas.SILVER_EVENTS, "events"),
        )
        return src

    @cached_property
    def users(self) -> DataFrame:
        return silver_users(self.spark, self.sf_dir)

    @cached_property
    def orders(self) -> DataFrame:
        return silver_orders(self.spark, self.sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        return silver_order_items(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return silver_events(self.spark, self.sf_dir)
