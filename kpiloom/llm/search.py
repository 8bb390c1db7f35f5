"""Ranked lexical search of many queries by shared partial sums.

The score of a document for an item is a sum over the item's terms, so items that
share terms share work.  For a block of items, pairs of terms (and of earlier pairs)
that stand together in several items are merged, the most shared first, into a
graph whose inner nodes are term sets.  A batch of documents gets an accumulator per
term, each inner node is added up once from its two parts, level by level, and an item
adds the few nodes that make it up.  Each task holds the best documents of every
item, and two small rankings merge the tasks'.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, written

#: Documents returned per item.
BEST = 50
#: Bytes of different terms in the items of a block, and its items; they bound what
#: the driver and each task hold.  Every block passes over the documents once.
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 1024
#: Terms in two or more items that sharing looks at, the most frequent; the others
#: are added item by item.
SHARED = 4096
#: Accumulator cells of a batch of documents.
CELLS = 4 << 20
#: Longer texts, in bytes, are counted stretch by stretch.
LONG = 8 << 20
#: First rankings over this many parts of the documents.
SALTS = 64

#: Separators of terms, and the letters put in lower case (fixed by contract).
_BREAK = bytes(b for b in range(0x80) if not chr(b).isalnum())
_TABLE = bytes(0x20 if b in _BREAK else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_terms(text: Column) -> Column:
    """The different terms of a text, sorted; none for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())
    return F.array_sort(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM_RE), 0)))


@dataclass
class Sharing:
    """The sums of a block: nodes 0 to n_terms - 1 are terms; a level (nodes, left,
    right) adds two earlier nodes each; item i adds parts[starts[i]:starts[i + 1]]."""

    n_terms: int
    n_nodes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    parts: np.ndarray
    starts: np.ndarray

    @property
    def additions(self) -> int:
        return sum(len(n) for n, _, _ in self.levels) + len(self.parts)

    def item_scores(self, gains: np.ndarray) -> np.ndarray:
        """(items x documents) from gains, (nodes x documents) with the terms' rows filled."""
        for nodes, left, right in self.levels:
            gains[nodes] = gains[left] + gains[right]
        out = np.zeros((len(self.starts) - 1, gains.shape[1]), np.int64)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.add.reduceat(gains[self.parts], self.starts[some], axis=0)
        return out


def share(items: list[np.ndarray], n_terms: int, shared: int = SHARED) -> Sharing:
    """Mine the term sets that items share.  Each round merges the pairs of nodes that
    stand together in most items, each node in one pair at most; a pair in c items
    costs one addition and saves c."""
    uses = np.bincount(np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64), minlength=n_terms)
    often = np.argsort(-uses, kind="stable")[:shared]
    node = np.sort(often[uses[often] > 1])                   # node of each column
    column = np.full(n_terms, -1)
    column[node] = np.arange(len(node))
    held = np.zeros((len(items), len(node)), bool)
    for i, terms in enumerate(items):
        at = column[terms]
        held[i, at[at >= 0]] = True
    levels, n_nodes = [], n_terms
    while held.shape[1] > 1:
        together = np.triu(held.astype(np.float32).T @ held.astype(np.float32), 1)
        a, b = np.nonzero(together > 1)
        free, pairs = np.ones(held.shape[1], bool), []
        for k in np.argsort(-together[a, b], kind="stable").tolist():
            if free[a[k]] and free[b[k]]:
                free[a[k]] = free[b[k]] = False
                pairs.append(k)
        if not pairs:
            break
        a, b = a[pairs], b[pairs]
        both = held[:, a] & held[:, b]
        held[:, a] &= ~both
        held[:, b] &= ~both
        made = np.arange(n_nodes, n_nodes + len(pairs))
        n_nodes += len(pairs)
        levels.append((made, node[a], node[b]))
        held, node = np.concatenate([held, both], axis=1), np.concatenate([node, made])
        live = held.sum(axis=0) > 0
        held, node = held[:, live], node[live]
    parts = [np.concatenate([node[held[i]], terms[column[terms] < 0]]) for i, terms in enumerate(items)]
    starts = np.cumsum([0, *map(len, parts)])
    return Sharing(n_terms, n_nodes, levels, np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64), starts)


def _vocabulary_counts(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """(n terms of each text; text, term, occurrences of those in the vocabulary)."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = pa.py_buffer(texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(_TABLE))
    moved = pa.py_buffer((at - at[0]).astype(np.int32).tobytes())
    words = pc.split_pattern(pa.Array.from_buffers(pa.string(), len(texts), [None, moved, data]), " ")
    flat, ends = words.flatten(), np.asarray(words.offsets).astype(np.int64)
    ends -= ends[0]
    real = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy() > 0)])
    which = pc.index_in(flat, value_set=vocabulary).fill_null(-1).to_numpy()
    hit = np.flatnonzero(which >= 0)
    text = np.searchsorted(ends, hit, side="right") - 1
    pair, tf = np.unique(text * np.int64(len(vocabulary) + 1) + which[hit], return_counts=True)
    return np.diff(real[ends]), pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1), tf


def count_terms(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """As :func:`_vocabulary_counts`, long texts stretch by stretch; a null text is empty."""
    texts = texts.fill_null("")
    if not len(texts):
        return (np.zeros(0, np.int64),) * 4
    size = pc.binary_length(texts).to_numpy()
    if size.max() <= LONG:
        return _vocabulary_counts(texts, vocabulary)
    cuts, owner = [], []
    for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        flat, at = t.translate(_TABLE) if len(t) > LONG else t, 0
        while at < len(t):
            end = flat.find(b" ", at + LONG) if len(t) - at > LONG else -1
            end = len(t) if end < 0 else end
            cuts.append(t[at:end])
            owner.append(i)
            at = end
    n, text, term, tf = _vocabulary_counts(pa.array(cuts, pa.binary()).cast(pa.string()), vocabulary)
    owner = np.array(owner)
    width = np.int64(len(vocabulary) + 1)
    pair, back = np.unique(owner[text] * width + term, return_inverse=True)
    return (np.bincount(owner, n, len(texts)).astype(np.int64), pair // width, pair % width,
            np.bincount(back, tf, len(pair)).astype(np.int64))


def counted(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms with repeats, and its terms of the
    vocabulary with their occurrences, both packed as little-endian 32-bit integers."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocab = pa.array(held.value, pa.string())
        for b in batches:
            n, text, term, tf = count_terms(b.column(1), vocab)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32) * 4
            packed = [pa.Array.from_buffers(pa.binary(), b.num_rows, [
                None, pa.py_buffer(ends.tobytes()), pa.py_buffer(v.astype("<i4").tobytes())]) for v in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *packed],
                                             names=["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms binary, tfs binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) // 4
    data = column.buffers()[2]
    values = np.frombuffer(data.to_pybytes() if data else b"", "<i4")[at[0]:at[-1]]
    return values, np.diff(at)


def term_weights(docs: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """(weight of each term, N, L) over all counted documents."""

    def count(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(_unpacked(b.column(0))[0], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], names=["term", "df"])

    n_docs, total = docs.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(n_terms, np.int64)
    for r in docs.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
    return np.array(weights, np.int64), n_docs, total or 0


class Best:
    """The best documents of each item so far; ties to the smaller id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]    # item, score, id, id is null
        self.new: list[list[np.ndarray]] = []
        self.size, self.room = 0, 4 * n_items * k + 4096

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[:, None])
        self.new.append([item, scores[item, doc], ids[doc], null[doc]])
        self.size += len(item)
        if self.size > self.room:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        every = [np.concatenate(c) for c in zip(self.held, *self.new)]
        item, score, ids, null = every
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.floor[every[0][last]] = np.maximum(score[last], 1)
        self.held, self.new, self.size = [c[keep] for c in every], [], 0
        return self.held


def scored(docs: DataFrame, sharing: Sharing, weights: np.ndarray, n_docs: int, total: int, best: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item of a block."""
    held = docs.sparkSession.sparkContext.broadcast((sharing, weights))
    step = max(1, CELLS // max(1, sharing.n_nodes + len(sharing.parts)))

    def run(batches):
        plan, weight = held.value
        found = Best(len(plan.starts) - 1, best)
        for b in batches:
            ids = b.column(0)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            n = b.column(1).to_numpy()
            if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
                n = n.astype(object)                        # exact beyond 64 bits too
            length = (100 - 50 + (50 * n * n_docs) // max(total, 1)).astype(np.int64)
            (term, counts), (tf, _) = _unpacked(b.column(2)), _unpacked(b.column(3))
            tf = tf.astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), counts)
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[doc]))
            ends = np.concatenate([[0], np.cumsum(counts)])
            for i in range(0, len(ids), step):
                j = min(i + step, len(ids))
                some = slice(ends[i], ends[j])
                cells = np.zeros((plan.n_nodes, j - i), np.int64)
                cells[term[some], doc[some] - i] = gain[some]
                found.add(plan.item_scores(cells), ids[i:j], null[i:j].astype(np.int64))
        item, score, ids, null = found.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())],
            names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def best_of(rows: DataFrame, keys: list[str], order: list[Column], k: int, salt: Column) -> DataFrame:
    """The first k rows of each key with their ``rank``, ranked in salted parts first."""
    parts = rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order)))
    kept = first.where(F.col("rank") <= k).drop("rank", "salt")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents with a score above 0 of each item.

    Null and wordless texts have no terms: such documents count in no statistic and
    such items return nothing.  Items that repeat an id with another text are items
    of their own; those that repeat both are one.  Every row of ``docs`` is a document
    (ids long; null ones after the others among equal scores).  Other columns are
    ignored; without documents or items there are no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), item_terms(F.col(item_text_col)).alias("words")) \
        .where(F.size("words") > 0).distinct()
    asked = written(asked, "search-items")
    n_items, size = asked.agg(F.count("*"), F.sum(F.octet_length(F.concat_ws(" ", "words")))).first()
    kind = asked.schema["item_id"].dataType.simpleString()
    blocks = max(1, -(-2 * n_items // block_items), -(-2 * (size or 0) // block_bytes)) if n_items > 1 else 1
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    out = None
    for i in range(blocks):
        own = asked.where(block == i).collect()
        if not own:
            continue
        vocabulary = sorted({w for r in own for w in r.words})
        place = {w: j for j, w in enumerate(vocabulary)}
        sharing = share([np.array(sorted(place[w] for w in r.words), np.int64) for r in own], len(vocabulary))
        rows = written(counted(docs, vocabulary, id_col, text_col), "search-counts")
        found = written(scored(rows, sharing, *term_weights(rows, len(vocabulary)), best), "search-scores")
        ranked = best_of(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], best, F.xxhash64("doc_id"))
        names = spark.createDataFrame([(j, r.item_id) for j, r in enumerate(own)], f"item bigint, item_id {kind}")
        ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out
