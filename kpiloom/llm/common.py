"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Upper bound of one Arrow batch handed to a Python worker.  Rows are whole
#: documents, so a bound in rows alone would let a run of long texts grow a batch
#: without limit.
ARROW_BATCH_BYTES = 4 << 20

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+`` words (fixed by contract).
WORD_RE = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches to Python workers by bytes (row bound left as set)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts lineage reliably (a lost executor re-reads files), gives the planner real
    sizes, and evaluates an expensive plan exactly once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
