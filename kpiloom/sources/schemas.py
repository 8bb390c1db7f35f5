"""Declared schemas.  Reading with a declared schema skips footer inference and
keeps column types stable across files."""

from pyspark.sql import types as T

# Raw driver tables (only the four the KPI models read).
CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()),
    T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()),
])

ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType()),
])

LINEITEM = T.StructType([
    T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()),
    T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()),
    T.StructField("l_linestatus", T.StringType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

RAW = {"customer": CUSTOMER, "orders": ORDERS, "lineitem": LINEITEM, "events": EVENTS}

# Silver (the four e-commerce sources the models are written against).
USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

SILVER_ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("sale_price", T.DoubleType()),
])

SILVER_EVENTS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("raw_event_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("traffic_source", T.StringType()),
])

# Gold feature table.
FEATURES = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("days_since_signup", T.LongType()),
    T.StructField("orders_30d", T.LongType()),
    T.StructField("revenue_30d", T.DoubleType()),
    T.StructField("frequency_30d", T.LongType()),
    T.StructField("pct_email", T.DoubleType()),
    T.StructField("pct_direct", T.DoubleType()),
    T.StructField("pct_organic", T.DoubleType()),
    T.StructField("pct_ads", T.DoubleType()),
    T.StructField("pct_social", T.DoubleType()),
    T.StructField("will_convert_14d", T.LongType()),
])
