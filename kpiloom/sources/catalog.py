"""Catalog helpers: first available feature table, non-empty load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_FEATURE_TABLE = "features_conversion"


def first_available_table(spark: SparkSession, candidates) -> str:
    """The first candidate (skipping empty names) that exists as a table or view."""
    tried = []
    for name in candidates:
        if not name:
            continue
        tried.append(name)
        if spark.catalog.tableExists(name):
            return name
    raise LookupError(f"no feature table found among {tried}; build the gold models first "
                      f"or pass an explicit table name")


def load_features(spark: SparkSession, candidates=(None, DEFAULT_FEATURE_TABLE)) -> tuple[DataFrame, str]:
    """The whole feature table of the first available candidate; an empty table
    raises (checked with a one-row probe, not a count)."""
    name = first_available_table(spark, candidates)
    df = spark.table(name)
    if df.isEmpty():
        raise ValueError(f"feature table {name} returned 0 rows")
    return df, name
