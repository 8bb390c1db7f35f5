"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and
one failure bit per rule.  A policy is a version and a mask of the rules it applies:
applying it, or asking what would change without a rule, is bit arithmetic on the
ledger and reads no text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bound_batches, written

#: Words of a repeated window.
WINDOW = 8
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Bytes that are not the first of a code point.
_CONTINUED = bytes(range(0x80, 0xC0))

#: Rules in bit order: name and SQL condition of failure on the measurements.
RULES = (
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BASE = ("too_few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = {p.version: p for p in (
    Policy("base", BASE),
    Policy("v1", (*BASE, "many_symbols", "duplicate_lines")),
    Policy("v2", tuple(n for n, _ in RULES)),
)}
CURRENT = "v2"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a ``window``-word window found twice or more in ``words``."""
    m = len(words) - window + 1
    if m < 2:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    a, z = (ends - size)[:m].tolist(), ends[window - 1:].tolist()
    h = np.fromiter((xxh64_intdigest(joined[i:j]) for i, j in zip(a, z)), np.uint64, m)
    order = np.argsort(h, kind="stable")
    equal = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(equal):
        return 0
    # equal hashes are checked on the words themselves
    seen: dict[bytes, int] = {}
    twice = set()
    for i in np.unique(np.concatenate([order[equal], order[equal + 1]])).tolist():
        first = seen.setdefault(joined[a[i]:z[i]], i)
        if first != i:
            twice.update((first, i))
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.fromiter(twice, np.int64, len(twice))
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(data: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    words = data.split()
    chars = len(data.translate(None, _SPACES + _CONTINUED))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i set if rule i fails.

    Null texts measure as empty ones.  Every row is measured by itself: repeated
    rows and null ids keep their rows, other columns are ignored, an empty table
    gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [measure(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = zip(*found) if found else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *MEASURES])

    fields = ", ".join(f"{m} bigint" for m in MEASURES)
    measured = rows.mapInArrow(run, f"doc_id {kind}, {fields}")
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i, (_, cond) in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.withColumn("failed", bits)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`ledger` written once in the shared checkpoint folder: any number of policies
    and ablations read its numbers, and no text is measured again."""
    return written(ledger(docs, id_col, text_col), "rules-ledger")


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` under ``policy`` and the policy's version."""
    return rows.withColumns({
        "kept": F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0,
        "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """rule, failed (documents failing it), only (failing it alone among the policy's
    rules, so kept without it), kept_without: one row per rule of the policy.

    One pass: documents are counted per distinct failure mask (at most
    2 ** rules groups), the rest is bit arithmetic on those counts.
    """
    mask = F.lit(policy.mask).cast("long")
    counts = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    rules = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for r in policy.rules]))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
        total(F.col("bits") == F.col("bit"))("only"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"))
