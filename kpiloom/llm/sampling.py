"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_STEPS = 1 << 30


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def per_label_sample(rows: DataFrame, label_col: str, keys: list[str], each: int) -> DataFrame:
    """About ``each`` rows of every label (all, if it has fewer), chosen by a hash of the
    ``keys``, so that any partitioning gives the same rows; rows that agree in label
    and keys are in the sample once, however often they stand.

    The labels are counted by one partial aggregate, and each row is joined with its
    label's count (broadcast by measured size): any number of labels will do.  A label
    with a third of all rows needs no sort and no single task: its rows are kept one
    by one where their hash falls under the label's share.
    """
    counts = written(rows.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("_n")), "label-counts")
    share = F.least(F.lit(_STEPS), F.floor(F.lit(_STEPS * each) / F.col("_n")))
    chosen = rows.join(counts, label_col).where(F.pmod(F.xxhash64(F.lit("fit"), *keys), F.lit(_STEPS)) < share)
    return chosen.select(*rows.columns).dropDuplicates([label_col, *keys])
