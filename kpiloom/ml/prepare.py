"""Feature selection, coercion and the seeded stratified split."""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import md5_prefix_int

TARGET = "will_convert_14d"
ID_COLUMNS = ("user_id",)
SEED = 42
TEST_FRACTION = 0.2
SPLIT_HEX_DIGITS = 12      # 48-bit hash
PROBE_BITS = 12            # bits of the hash that one counting pass resolves
FEW_CLASSES = 20           # from so many label values on, thresholds are joined
MAX_CLASSES = 1000         # label values a split accepts: it holds a threshold of each


def feature_columns(df: DataFrame, id_cols=ID_COLUMNS, target: str = TARGET) -> list[str]:
    """All columns except the ids and the target, in table order."""
    drop = set(id_cols) | {target}
    return [c for c in df.columns if c not in drop]


_WS = r"(?U)^\s+|\s+$"                 # Unicode whitespace at either end
_DIGIT_UNDERSCORE = r"(?<=\d)_(?=\d)"      # one '_' between digits, as Python's float() allows

# What float() accepts: a decimal number with an optional exponent, or a non-finite name.
_NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


@lru_cache(maxsize=1)
def _unicode_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit and its ASCII value, built from the
    Unicode database (Python's float() reads digits of any script)."""
    src, dst = [], []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if ch.isdecimal() and not ("0" <= ch <= "9"):
            src.append(ch)
            dst.append(str(unicodedata.decimal(ch)))
    return "".join(src), "".join(dst)


def _text_to_double(c: Column) -> Column:
    """Text parsed like Python's ``float()`` after stripping whitespace and one
    pair of surrounding brackets; unparsable text is 0."""
    s = F.regexp_replace(c, _WS, "")
    bracketed = s.startswith("[") & s.endswith("]")
    inner = F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), _WS, "")
    s = F.when(bracketed, inner).otherwise(s)
    src, dst = _unicode_digits()
    s = F.regexp_replace(F.translate(s, src, dst), _DIGIT_UNDERSCORE, "")
    # the cast alone also reads Java's own forms ("1d", "1.5f", "0x1p3")
    return F.coalesce(F.when(s.rlike(_NUMBER), s.try_cast("double")), F.lit(0.0))


def coerce_column(c: Column, dtype: T.DataType) -> Column:
    """One cell -> double, by the cell's type:

    null -> 0; number or boolean -> its value (NaN stays NaN); text -> strip,
    drop one pair of surrounding brackets, parse, else 0; list -> its first
    element (recursively), empty -> 0; anything else -> 0.  Decimals are cast
    (the original drops them to 0 by accident).
    """
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                          T.DecimalType, T.BooleanType)):
        out = c.cast("double")
    elif isinstance(dtype, T.StringType):
        out = _text_to_double(c)
    elif isinstance(dtype, T.ArrayType):
        first = coerce_column(F.try_element_at(c, F.lit(1)), dtype.elementType)
        out = F.when(F.size(c) > 0, first)
    else:
        return F.lit(0.0)
    return F.coalesce(out, F.lit(0.0))


def coerce_features(df: DataFrame, id_cols=ID_COLUMNS, target: str = TARGET) -> tuple[DataFrame, list[str]]:
    """Ids and target untouched (target cast to bigint), every feature a double."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found in the feature table")
    feats = feature_columns(df, id_cols, target)
    types = {f.name: f.dataType for f in df.schema.fields}
    keep = [c for c in id_cols if c in df.columns]
    out = df.select(*keep, *[coerce_column(F.col(f), types[f]).alias(f) for f in feats],
                    F.col(target).cast("bigint").alias(target))
    return out, feats


def split_hash(id_col: str, seed: int = SEED) -> Column:
    return md5_prefix_int(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), SPLIT_HEX_DIGITS)


def split_thresholds(hashed: DataFrame, label: str, train_fraction: float) -> dict:
    """``{label value: largest training hash}``, exact at any size.

    Per label value the threshold is the smallest hash ``_h`` that at least
    ``train_fraction`` of its rows are at or below.  Each pass is one partial
    aggregate that counts rows per label and leading hash bits, first over all
    rows, then inside the one cell the threshold lies in, so the driver sees at
    most 2 ** PROBE_BITS counts per label and pass.  Counts do not depend on
    partitioning, so neither do the thresholds.

    A class of two or more different hashes keeps at least one row on each side:
    if its threshold is its largest hash, it drops to the second largest.

    Per-label values meet the rows by a join with a table of one row per label (at most
    ``MAX_CLASSES``, so it is broadcast), not as a chain of conditions, whose depth
    would grow with the labels.

    Rows without a label raise a ``ValueError`` that names their number.
    """
    spark = hashed.sparkSession
    kind = hashed.schema[label].dataType.simpleString()

    def with_value(rows: DataFrame, values: dict, name: str) -> DataFrame:
        """``rows`` of the given labels with their value."""
        return rows.join(F.broadcast(spark.createDataFrame(list(values.items()), f"`{label}` {kind}, {name} bigint")), label)

    total_bits = 4 * SPLIT_HEX_DIGITS
    stats = hashed.groupBy(label).agg(F.max("_h"), F.count(F.lit(1))).limit(MAX_CLASSES + 1).collect()
    counts = {r[0]: r[2] for r in stats}
    if None in counts:
        raise ValueError(f"{counts[None]} row(s) without a value of the target {label!r}")
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} values of the target {label!r}")

    def find(rank: dict) -> dict:
        """The hash at a 1-based rank of each label's rows."""
        cell = {y: 0 for y in rank}
        left = dict(rank)
        for bits in range(PROBE_BITS, total_bits + 1, PROBE_BITS):
            if not left:
                break
            at = F.shiftright("_h", total_bits - bits).alias("_cell")
            rows = with_value(hashed, cell, "_in")
            if bits > PROBE_BITS:
                rows = rows.where(F.shiftright("_h", total_bits - bits + PROBE_BITS) == F.col("_in"))
            sizes: dict = {}
            for r in rows.groupBy(label, at).agg(F.count(F.lit(1)).alias("_n")).toLocalIterator():
                sizes.setdefault(r[label], []).append((r["_cell"], r["_n"]))
            for y in left:
                for c, n in sorted(sizes.get(y, [])):
                    if left[y] <= n:
                        cell[y] = c
                        break
                    left[y] -= n
        return cell

    want = {y: max(1, math.ceil(train_fraction * n - 1e-9)) for y, n in counts.items()}
    found = find(want)
    largest = {r[0]: r[1] for r in stats}
    full = [y for y in counts if counts[y] >= 2 and found[y] >= largest[y]]
    if full:
        below = with_value(hashed, {y: largest[y] for y in full}, "_largest").where(F.col("_h") < F.col("_largest"))
        found |= {r[0]: r[1] for r in below.groupBy(label).agg(F.max("_h")).collect()}
    return found


def assign_split(df: DataFrame, label: str = TARGET, id_col: str = "user_id",
                 test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Adds ``split`` ('train' / 'test'): per label, rows whose seeded id hash is at
    or below the label's threshold (:func:`split_thresholds`) train, the rest
    test, so the class ratio is kept on both sides.

    The thresholds are found here, by counting passes over ``df`` (give a written
    or checkpointed table if it is expensive); the result compares each row's
    hash with its label's threshold (a literal each, or from ``FEW_CLASSES`` labels on
    a broadcast table of them), so every row lands on exactly one side, whatever the
    partitioning.  A null label raises ``ValueError``.
    """
    h = split_hash(id_col, seed)
    found = split_thresholds(df.select(F.col(label), h.alias("_h")), label, 1.0 - test_fraction)
    if len(found) >= FEW_CLASSES:
        kind = df.schema[label].dataType.simpleString()
        limits = F.broadcast(df.sparkSession.createDataFrame(list(found.items()), f"`{label}` {kind}, _limit bigint"))
        joined = df.withColumn("_h", h).join(limits, label, "left")
        return joined.withColumn("split", F.when(F.col("_h") <= F.col("_limit"), "train").otherwise("test")).select(
            *df.columns, "split")
    limit = F.lit(None).cast("bigint")
    for y, t in found.items():
        limit = F.when(F.col(label) == F.lit(y), F.lit(t)).otherwise(limit)
    return df.withColumn("split", F.when(h <= limit, "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str = TARGET, id_col: str = "user_id",
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    s = assign_split(df, label, id_col, test_fraction, seed)
    return (s.filter(F.col("split") == "train").drop("split"),
            s.filter(F.col("split") == "test").drop("split"))
