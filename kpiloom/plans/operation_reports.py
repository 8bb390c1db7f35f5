"""Reports on the upkeep of the models: incremental gold, relationships between the
silver tables, and bounds of the daily metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quality as dq
from ..session import scratch_path
from ..sources.silver import Sources
from .incremental import IncrementalGold
from .reports import _revenue_daily, _state_of, report


_FED: dict = {}


def _dealt(src: Sources) -> IncrementalGold:
    """Gold fed with all rows of the sources in batches that come out of order: items
    before their orders, days that were applied before, and a batch sent twice.  The
    reports on a data directory share the newest one, while its files stay as they are."""
    if src.given:
        return _fed(src)
    key = _state_of(src)
    if key not in _FED:
        _FED.clear()
        _FED[key] = _fed(src)
    return _FED[key]


def _fed(src: Sources) -> IncrementalGold:
    gold = IncrementalGold(src.spark, scratch_path(src.spark, f"incremental/{uuid.uuid4().hex}"))

    def deal(key: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(key), F.lit(3)), F.lit(0))

    o, i, e = deal("order_id"), deal("order_id"), F.dayofmonth(F.col("created_at").cast("date")) % 2
    gold.apply("items-first", items=src.items.where(i == 2))
    gold.apply("first", orders=src.orders.where(o == 0), items=src.items.where(i == 0),
               events=src.events.where(F.coalesce(e, F.lit(0)) == 0))
    gold.apply("second", orders=src.orders.where(o != 0), events=src.events.where(e == 1))
    gold.apply("first", orders=src.orders.where(o == 0), items=src.items.where(i == 0))
    gold.apply("items-last", items=src.items.where(i == 1))
    return gold


@report("incremental_revenue")
def _incremental_revenue(src: Sources) -> DataFrame:
    return _dealt(src).revenue_daily()


@report("incremental_activity")
def _incremental_activity(src: Sources) -> DataFrame:
    return _dealt(src).activity_daily()


@report("incremental_retention")
def _incremental_retention(src: Sources) -> DataFrame:
    return _dealt(src).retention_weekly(src.users)


@report("dq_relationships")
def _dq_relationships(src: Sources) -> DataFrame:
    return dq.run_relationships({"users": src.users, "orders": src.orders, "order_items": src.items,
                                 "events": src.events})


@report("dq_bounds")
def _dq_bounds(src: Sources) -> DataFrame:
    """The daily revenue metrics against their four weeks before."""
    return dq.metric_bounds(_revenue_daily(src), "day", ["orders", "revenue", "aov"])
