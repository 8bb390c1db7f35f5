"""Packing of documents into training sequences by lexical retrieval.

Every document becomes its token ids and an end id.  Its full windows are sequences
of their own; what is left over, less than a window, is a fragment.  Fragments go by
one range exchange into shards in the order of two weighted min-hashes of their
tokens, so that fragments which share rare tokens meet in a shard, and copies stand
side by side.  Each shard is a BM25 inverted index over token ids, weighed by the
document frequencies of all fragments.  A seed fragment opens a window, its unused
neighbours by BM25 fill it greedily, and where none fits, the best one is cut; its rest
stays in the index.  A window that a shard can't fill goes on into the next shard of
the task, and the last one of a task is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bound_batches, written
from .token_files import byte_bpe, id_type, laid_out

#: Ids in a sequence, and the id that ends a document.
SEQ_LEN = 1024
END_ID = 0
#: Fragments in a shard's index, and fragments that a task of the range exchange gets.
SHARD = 1024
PER_TASK = 16 * SHARD
#: Neighbours that a window looks at before it cuts one.
NEIGHBOURS = 64
#: BM25 saturation and length weight.
K1, B = 1.2, 0.75
SEED = 23

PIECE = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
FRAGMENT = PIECE + ", part int, window bigint, ids binary"


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, seq_len: int) -> DataFrame:
    """A row for each full window of a document (part and window say which sequence
    it is), and one for what is left over (ids say what it holds)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dtype = id_type(path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe, part, window = byte_bpe(path, dtype), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, counts = bpe.encode_rows(b.column(1), end_id)
            behind = np.cumsum(counts)
            which, starts, sizes, crcs, windows, left = [], [], [], [], [], []
            for i, (n, at) in enumerate(zip(counts.tolist(), (behind - counts).tolist())):
                for s in range(0, n, seq_len):
                    held = ids[at + s:at + min(s + seq_len, n)]
                    which.append(i)
                    starts.append(s)
                    sizes.append(len(held))
                    if len(held) == seq_len:
                        crcs.append(crc(held))
                        windows.append(window)
                        left.append(None)
                        window += 1
                    else:
                        crcs.append(None)
                        windows.append(None)
                        left.append(held.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which, pa.int64())), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(counts[which], pa.int64()),
                 pa.array([part] * len(which), pa.int32()), pa.array(windows, pa.int64()),
                 pa.array(left, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "ids"])

    return rows.mapInArrow(run, FRAGMENT.format(id=kind))


def binary_ids(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, counts) of a column of packed ids."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
    return np.frombuffer(data.tobytes(), dtype), np.diff(at) // np.dtype(dtype).itemsize


def postings(ids: np.ndarray, counts: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, rows, occurrences) in the order of terms, then rows."""
    rows = np.repeat(np.arange(len(counts)), counts)
    pair, tf = np.unique(ids.astype(np.int64) * len(counts) + rows, return_counts=True)
    return pair // max(len(counts), 1), pair % max(len(counts), 1), tf


def document_frequencies(fragments: DataFrame, dtype: str, vocab: int) -> np.ndarray:
    """How many fragments hold each token id; its size is the vocabulary's."""

    def count(batches):
        df = np.zeros(vocab, np.int64)
        for b in batches:
            ids, counts = binary_ids(b.column(0), dtype)
            for i in range(0, len(counts), SHARD):
                n = counts[i:i + SHARD]
                at = counts[:i].sum()
                df += np.bincount(postings(ids[at:at + n.sum()], n, vocab)[0], minlength=vocab)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], names=["term", "df"])

    total = np.zeros(vocab, np.int64)
    for r in fragments.select("ids").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).toLocalIterator():
        total[r.term] = r.df
    return total


def routes(idf: np.ndarray, dtype: str):
    """Two weighted min-hashes of a fragment's tokens: the chance that two fragments
    agree in one is about the share of their idf that they share."""
    rng = np.random.default_rng(SEED)
    ranks = [np.argsort(np.argsort(rng.exponential(size=len(idf)) / np.maximum(idf, 1e-9))) for _ in range(2)]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, counts = binary_ids(b.column(b.num_columns - 1), dtype)
            start = np.cumsum(counts) - counts
            near = [pa.array(np.minimum.reduceat(r[ids], start), pa.int64()) for r in ranks]
            yield pa.RecordBatch.from_arrays([*b.columns, *near], names=[*b.schema.names, "near", "next"])

    return run


class Shard:
    """BM25 index over the fragments of a shard, from which windows take neighbours."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float):
        self.ids, self.counts = ids, counts
        self.at = np.cumsum(counts) - counts
        term, row, tf = postings(ids, counts, len(idf))
        gain = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * counts[row] / mean))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        self.term = np.full(len(idf), -1)
        self.term[term[starts]] = np.arange(len(starts))
        self.size = np.diff(starts, append=len(term))
        self.row, self.gain, self.place = row, gain, np.arange(len(row))
        self.used = np.zeros(len(counts), np.int64)     # ids taken of each fragment
        self.open = np.ones(len(counts), bool)
        self.first = 0

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """Unused fragments that share tokens with ``ids``, the best first."""
        terms = self.term[np.unique(ids)]
        at = laid_out(self.place, self.size, terms[terms >= 0])
        score = np.bincount(self.row[at], self.gain[at], len(self.counts))
        score[~self.open] = 0
        top = np.argpartition(-score, min(NEIGHBOURS, len(score)) - 1)[:NEIGHBOURS]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]

    def next_open(self) -> int | None:
        """The first unused fragment."""
        while self.first < len(self.open) and not self.open[self.first]:
            self.first += 1
        return self.first if self.first < len(self.open) else None

    def rest(self, i: int) -> int:
        return int(self.counts[i] - self.used[i])

    def take(self, i: int, n: int) -> tuple[int, np.ndarray]:
        """(where it starts in the fragment, ids) of the next n ids of fragment i."""
        at = int(self.used[i])
        self.used[i] += n
        self.open[i] = self.rest(i) > 0
        return at, self.ids[self.at[i] + at:self.at[i] + at + n]


class Packer:
    """Fills windows from shard after shard; ``pieces`` holds (row, start in the
    fragment, length, crc32, window, offset)."""

    def __init__(self, seq_len: int):
        self.seq_len, self.window, self.filled = seq_len, 0, 0
        self.seed: np.ndarray | None = None         # ids by which the open window was begun
        self.held: list[tuple[object, int, np.ndarray]] = []
        self.pieces: list[tuple] = []

    def _put(self, shard: Shard, names: list, i: int, n: int) -> None:
        at, ids = shard.take(i, n)
        self.held.append((names[i], at, ids))
        self.filled += n
        if self.filled == self.seq_len:
            self._close()

    def _close(self) -> None:
        offset = 0
        for name, at, ids in self.held:
            self.pieces.append((name, at, len(ids), crc(ids), self.window, offset))
            offset += len(ids)
        self.window, self.filled, self.held, self.seed = self.window + 1, 0, [], None

    def fill(self, shard: Shard, names: list) -> None:
        """Use up a shard; the last window may stay open."""
        while (first := shard.next_open()) is not None:
            if self.seed is None:
                self.seed = shard.ids[shard.at[first] + shard.used[first]:shard.at[first] + shard.counts[first]]
                self._put(shard, names, first, min(shard.rest(first), self.seq_len))
                continue
            window, near = self.window, shard.neighbours(self.seed).tolist()
            for i in near:
                if shard.rest(i) <= self.seq_len - self.filled:
                    self._put(shard, names, i, shard.rest(i))
                    if self.window != window:
                        break
            if self.window != window:
                continue
            room = self.seq_len - self.filled
            over = next((i for i in near if shard.open[i]), None)
            if over is None and (over := shard.next_open()) is None:
                break
            self._put(shard, names, over, min(room, shard.rest(over)))

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        held, self.held, self.filled = self.held, [], 0
        total = sum(len(ids) for _, _, ids in held)
        while held:
            size = 1 << (total.bit_length() - 1)
            total -= size
            while size:
                name, at, ids = held.pop(0)
                self.held.append((name, at, ids[:size]))
                if len(ids) > size:
                    held.insert(0, (name, at + size, ids[size:]))
                size -= len(self.held[-1][2])
            self._close()


def pack_fragments(fragments: DataFrame, dtype: str, idf: np.ndarray, mean: float, seq_len: int) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, part, window, offset) of
    fragments (doc_id, start, doc_tokens, .., ids), in shards of the order they come in."""
    kind = fragments.schema["doc_id"].dataType.simpleString()

    def run(batches):
        # a random name: a retried task's windows never mix with another attempt's
        part, packer = uuid.uuid4().hex, Packer(seq_len)
        held, n_held = [], 0

        def pack():
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, counts = binary_ids(rows.column("ids").combine_chunks(), dtype)
            names = list(zip(rows.column("doc_id").to_pylist(), rows.column("start").to_pylist(),
                             rows.column("doc_tokens").to_pylist()))
            packer.fill(Shard(ids, counts, idf, mean), names)

        def out():
            got, packer.pieces = packer.pieces, []
            names = [p[0] for p in got]
            cols = [[n[0] for n in names], [n[1] + p[1] for n, p in zip(names, got)], [p[2] for p in got],
                    [p[3] for p in got], [n[2] for n in names], [part] * len(got),
                    [p[4] for p in got], [p[5] for p in got]]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_kind), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5]),
                 *(pa.array(c, pa.int64()) for c in cols[6:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset"])

        id_kind = pa.int64()
        for b in batches:
            id_kind = b.schema.field("doc_id").type
            while b.num_rows:
                room = SHARD - n_held
                held.append(b.slice(0, room))
                n_held += held[-1].num_rows
                b = b.slice(room)
                if n_held == SHARD:
                    pack()
                    held, n_held = [], 0
                    yield out()
        if n_held:
            pack()
        packer.finish()
        yield out()

    return fragments.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(
        run, PIECE.format(id=kind) + ", part string, window bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    ``seq_len`` must be a power of two.  A sequence holds seq_len ids, but for those at
    the end of a task, whose lengths are smaller powers of two; sequence ids are
    gapless from 0.  Null and empty texts hold the end id alone.  Every row is a
    document of its own: rows that share an id, or have none, all keep their pieces.
    Other columns are ignored; an empty table gives no rows.  Equal fragments are
    neighbours of each other like any others: a group of copies, however large, is
    dealt over tasks by a hash of the row, and its shards index at most ``SHARD`` of them.
    """
    if seq_len & (seq_len - 1):
        raise ValueError(f"{seq_len} is no power of two")
    dtype, vocab = id_type(path), Tokenizer.from_file(path).get_vocab_size()
    vocab = max(vocab, end_id + 1)
    rows = written(tokenised(docs, path, id_col, text_col, end_id, seq_len), "packing-tokens")
    fragments = rows.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids")
    n, total = fragments.agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    full = rows.where("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.format_string("full-%010d", "part").alias("part"),
        "window", F.lit(0).cast("long").alias("offset"))
    pieces = full
    if n:
        mean = total / n / np.dtype(dtype).itemsize
        df = document_frequencies(fragments, dtype, vocab)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        near = fragments.mapInArrow(
            routes(idf, dtype), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fragments.schema)
            + ", near bigint, next bigint")
        spread = F.xxhash64("doc_id", "start", "ids")
        dealt = near.withColumn("h", spread).repartitionByRange(-(-n // PER_TASK), "near", "next", "h") \
            .sortWithinPartitions("near", "next", "h")
        pieces = full.union(pack_fragments(dealt, dtype, idf, mean, seq_len))
    pieces = written(pieces, "packing-pieces")
    # one row per task; sequence ids go on from task to task
    parts = written(pieces.groupBy("part").agg((F.max("window") + 1).alias("n")), "packing-parts")
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return pieces.join(before, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("before") + F.col("window")).alias("sequence_id"), "offset")
