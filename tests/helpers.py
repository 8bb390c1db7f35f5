"""Small hand-built silver tables for edge-case tests."""

import datetime as dt

from kpiloom.sources import schemas


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def users(spark, rows):
    return spark.createDataFrame([(i, ts(c) if c else None) for i, c in rows], schemas.USERS)


def orders(spark, rows):
    return spark.createDataFrame([(o, u, st, ts(c) if c else None) for o, u, st, c in rows], schemas.SILVER_ORDERS)


def items(spark, rows):
    return spark.createDataFrame(rows, schemas.ORDER_ITEMS)


def events(spark, rows):
    """rows: (user_id, event_type, created_at, traffic_source); raw type = event type."""
    return spark.createDataFrame([(u, e, e, ts(c), s) for u, e, c, s in rows], schemas.SILVER_EVENTS)
