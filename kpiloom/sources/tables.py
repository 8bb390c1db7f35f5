"""Raw table access (bronze)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import schemas


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; the four KPI sources use their declared schema."""
    reader = spark.read
    if name in schemas.RAW:
        reader = reader.schema(schemas.RAW[name])
    return reader.parquet(table_path(sf_dir, name))
