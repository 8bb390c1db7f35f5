"""Token ids as Arrow files of fixed-size lists, read back without copies.

Documents are put in id order by one range exchange; each partition writes one Arrow
file whose record batches hold sequences of equal length as fixed-size lists, with a
mask of the positions that hold ids (the last sequence of a file is filled up).  Any
sequence is at a computable place in a memory-mapped file.  A document index says
where each document starts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import LONGEST, PieceCache, byte_letters
from .common import bound_batches, scratch, written
from .files import OnceFile, store

#: Ids in a sequence, and sequences in a full record batch.
SEQ_LEN = 1024
SEQS = 512
#: Id that ends each document.
END_ID = 2
#: Ids of one stretch of a file that a reading task takes at a time.
STRETCH = 8 << 20

#: Pieces held by each of the two generations of a worker's cache.
CACHED = 300_000

INDEX = "doc_id {id}, part int, file string, start_in_file bigint, n_tokens bigint"
#: A space between two characters that are not white space: no pre-token crosses it
#: or ends behind it, so the text can be cut in front of it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_STOPS = ".,;:!?"
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
_LATIN = re.compile("[\n\x21-\x7e\u00a1-\u024f]+").fullmatch
#: Pre-tokens of byte-level vocabularies (fixed by the file format).
_PRE_TOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


#: White space other than space and line feed, which are the two places of fast cuts.
_OTHER_SPACE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts whose spaces and line feeds are not all pre-token starts: runs of white space
#: (two line feeds are still two pre-tokens), a space at an end, special tokens.
_RUNS = (rf" [ \n{_OTHER_SPACE}]|[\n{_OTHER_SPACE}] |\n[{_OTHER_SPACE}]|[{_OTHER_SPACE}]\n"
         r"|\n\n\n|\n\n$| $|^ |^\n\n|^\n$|<\|")
#: Bytes that are no part of a Latin letter (U+00C0 to U+023F beside ASCII), and the
#: place of each stop.
_ODD = np.ones(256, bool)
_ODD[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = False
_STOP_AT = np.full(256, -1)
_STOP_AT[list(_STOPS.encode())] = range(len(_STOPS))
#: Longer texts, in bytes, are encoded stretch by stretch.
LONG = 4 << 20


class _Uncut(Exception):
    """A piece with white space at an end: its neighbours decide its pre-tokens."""


def laid_out(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values``, one after the other; run i has sizes[i] values."""
    n = sizes[which]
    shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n)
    return values[np.repeat(shift, n) + np.arange(n.sum())]


class ByteBPE:
    """Ids of whole texts as the tokenizers library gives them for a byte-level file.

    A text is cut in front of single inner spaces, where pre-tokens always end, and
    equal pieces are encoded once per worker.  The pre-tokens of Latin text go
    straight to the library's BPE model; all else goes through its whole tokenizer.
    ``encode_rows`` cuts the texts of a batch at once in Arrow, at line feeds too,
    takes line feed and full stop off Latin words, looks up each different word of
    the batch once and lays the ids out by numpy.
    """

    def __init__(self, path: str, dtype: str = "<u2"):
        self.tok, self.dtype = Tokenizer.from_file(path), dtype
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.code = np.dtype(dtype).char
        self.letters = byte_letters()
        self.pieces = PieceCache(self.encode_piece, CACHED)
        self.tokens = PieceCache(self.encode_token, 50_000)
        self.keys = PieceCache(self.encode_key, CACHED)
        self.words, self.old_words = {}, {}
        self.as_letters = dict(enumerate(self.letters)) | {10: "\n"}
        self.line_feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_token(self, token: str) -> bytes:
        """Ids of one pre-token."""
        if token.isascii():         # of these, only space and line feed have other letters
            token = token.replace(" ", "\u0120").replace("\n", "\u010a")
        else:
            token = "".join(map(self.letters.__getitem__, token.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(token)]).tobytes()

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a space and ``piece``."""
        if _WORD(piece):
            return self.encode_token(" " + piece)
        if piece and piece[-1] in _STOPS and _WORD(piece[:-1]):
            return self.pieces[piece[:-1]] + self.tokens[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uncut
        if _LATIN(piece) and "<|" not in piece:
            return b"".join(map(self.tokens.__getitem__, _PRE_TOKENS(" " + piece)))
        return self._whole(" " + piece)

    def encode_key(self, key: str) -> bytes:
        """Ids of a piece of a batch: behind a line feed it begins with it, else a
        space stands before it."""
        if key[0] != "\n":
            return self._whole(" " + key) if key[-1].isspace() else self.encode_piece(key)
        return self.line_feed + (self._whole(key[1:]) if key[1:] else b"")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of different Latin words, those with a space before it included."""
        found = list(map(self.words.get, words))
        new = [w for w, f in zip(words, found) if f is None]
        if not new:
            return found
        fresh = list(map(self.old_words.get, new))
        unknown = [w for w, f in zip(new, fresh) if f is None]
        if unknown:
            letters = "\n".join(unknown).encode().decode("latin-1").translate(self.as_letters).split("\n")
            tokenize, code = self.model.tokenize, self.code
            ids = iter([array(code, [t.id for t in tokenize(w)]).tobytes() for w in letters])
            fresh = [next(ids) if f is None else f for f in fresh]
        if len(self.words) + len(new) > CACHED:
            self.old_words, self.words = self.words, {}
        self.words.update(zip(new, fresh))
        fill = iter(fresh)
        return [next(fill) if f is None else f for f in found]

    def _key_ids(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of different pieces, none empty."""
        at = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, 4 * keys.offset)
        data = np.frombuffer(keys.buffers()[2], np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        odd = _ODD[data]
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))     # two signs among the letters
        n_odd = np.diff(np.concatenate([[0], np.cumsum(odd)])[at])
        fed, stop = data[at[:-1]] == 10, _STOP_AT[data[at[1:] - 1]]
        size = np.diff(at)
        plain = (n_odd == fed + (stop >= 0)) & (size > n_odd) & (size <= LONGEST)
        some = pa.array(plain)
        word = pc.ascii_trim(keys.filter(some), "\n" + _STOPS)
        behind_space = pa.array(~fed[plain])
        word = pc.if_else(behind_space, pc.binary_join_element_wise(" ", word, ""), word).dictionary_encode()
        pool = self.encode_words(word.dictionary.to_numpy(zero_copy_only=False).tolist())
        n_words = len(pool)
        pool += map(self.keys.__getitem__, keys.filter(pc.invert(some)).to_pylist())
        n_pool = len(pool)
        pool += [self.line_feed, *map(self.tokens.__getitem__, _STOPS)]
        # the units that make up each piece: a line feed, a word or other piece, a stop
        fed, stop = fed & plain, np.where(plain, stop, -1)
        n = 1 + fed + (stop >= 0)
        start = np.cumsum(n) - n
        units = np.empty(n.sum(), np.int64)
        units[start[fed]] = n_pool
        own = start + fed
        units[own[plain]] = word.indices.to_numpy()
        units[own[~plain]] = np.arange(n_words, n_pool)
        ended = stop >= 0
        units[own[ended] + 1] = n_pool + 1 + stop[ended]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // np.dtype(self.dtype).itemsize
        ids = laid_out(np.frombuffer(b"".join(pool), self.dtype), sizes, units)
        return ids, np.add.reduceat(sizes[units], start)

    def _encode_plain(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts without ``_RUNS``, each followed by ``end``."""
        cut = pc.replace_substring(texts, "\n", " \n")
        pieces = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", texts.type), cut, ""), " ")
        first = np.asarray(pieces.offsets)[:-1].astype(np.int64)
        first -= first[:1]
        coded = pieces.flatten().dictionary_encode()
        ids, sizes = self._key_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        out = laid_out(ids, sizes, which)
        n = sizes[which]
        # every text begins with the id of the line feed put before it: the text
        # before ends there, and the first of these ids goes to the very end
        starts = (np.cumsum(n) - n)[first]
        out[starts] = end
        return np.append(out[1:], out[:1]), np.diff(starts, append=len(out))

    def encode_rows(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each followed by ``end``; how many
        each text has).  A null text is empty."""
        texts = texts.fill_null("")
        slow = pc.or_(pc.match_substring_regex(texts, _RUNS),
                      pc.greater(pc.binary_length(texts), LONG)).to_numpy(zero_copy_only=False)
        if not slow.any():
            return self._encode_plain(texts, end) if len(texts) else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        counts = np.zeros(len(texts), np.int64)
        fast = ~slow
        ids = np.zeros(0, self.dtype)
        if fast.any():
            ids, counts[fast] = self._encode_plain(texts.filter(pa.array(fast)), end)
        last = np.array([end], self.dtype)
        parts, at = [], 0
        for i, kept in zip(np.flatnonzero(slow), np.cumsum(counts)[slow]):
            own = np.frombuffer(self.encode(texts[int(i)].as_py()), self.dtype)
            parts += [ids[at:kept], own, last]
            counts[i], at = len(own) + 1, kept
        return np.concatenate([*parts, ids[at:]]), counts

    def encode(self, text: str) -> bytes:
        """Ids of one text; long ones stretch by stretch."""
        out, at = [], 0
        while len(text) - at > LONG and (cut := _CUT.search(text, at + LONG)):
            out.append(self._encode(text[at:cut.start()]))
            at = cut.start()
        return b"".join([*out, self._encode(text[at:])])

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Uncut
            return self._whole(first) + b"".join(map(self.pieces.__getitem__, rest))
        except _Uncut:
            first, *rest = _CUT.split(text)
            out = [self._whole(first)]
            for p in rest:
                out.append(self._whole(" " + p) if p[-1].isspace() else self.pieces[p])
            return b"".join(out)


@lru_cache(maxsize=2)
def byte_bpe(path: str, dtype: str) -> ByteBPE:
    """One encoder per worker process: its cache serves all tasks the worker runs."""
    return ByteBPE(path, dtype)


def id_type(path: str) -> str:
    """The smallest unsigned type that holds every id of the vocabulary."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in full record batches."""

    def __init__(self, out: OnceFile, dtype: str, seq_len: int, seqs: int, part: int):
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema([pa.field("ids", pa.list_(kind, seq_len)),
                                 pa.field("mask", pa.list_(pa.bool_(), seq_len))],
                                metadata={"seq_len": str(seq_len), "part": str(part)})
        self.out, self.kind, self.dtype, self.seq_len = out, kind, dtype, seq_len
        self.full = seq_len * seqs * np.dtype(dtype).itemsize
        self.held: list[bytes] = []
        self.size = self.at = 0
        self.writer = None

    def add(self, ids: bytes) -> None:
        """Append ids; those of many documents at once are fine."""
        self.held.append(ids)
        self.size += len(ids)
        self.at += len(ids) // np.dtype(self.dtype).itemsize
        if self.size >= self.full:
            data = b"".join(self.held)
            whole = self.size - self.size % self.full
            for i in range(0, whole, self.full):
                self._batch(np.frombuffer(data, self.dtype, self.full // np.dtype(self.dtype).itemsize, i))
            self.held, self.size = [data[whole:]], self.size - whole

    def _batch(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.seq_len) * self.seq_len
        mask = np.arange(n) < len(ids)
        if n > len(ids):
            ids = np.concatenate([ids, np.zeros(n - len(ids), self.dtype)])
        if self.writer is None:
            self.writer = pa.ipc.new_file(self.out.open(), self.schema)
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.seq_len),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._batch(np.frombuffer(b"".join(self.held), self.dtype))
        if self.writer is not None:
            self.writer.close()
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID, seq_len: int = SEQ_LEN,
                      seqs: int = SEQS) -> DataFrame:
    """Encode every text, append ``end_id``, write the ids in ascending id order and
    return the document index: doc_id, part, file, start (ids of all documents
    before it), start_in_file, n_tokens.

    Null and empty texts hold the end id alone.  Null ids come first; rows that
    share an id are ordered by text hash, then text, and a hot id is dealt over
    several partitions by that hash.  Other columns are ignored; an empty table
    writes no file.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    dtype = id_type(path)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def write(batches):
        part = TaskContext.get().partitionId()
        bpe = out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                bpe = byte_bpe(path, dtype)
                out = SequenceWriter(OnceFile(folder, f"part-{part:06d}-{uuid.uuid4().hex}.arrow"),
                                     dtype, seq_len, seqs, part)
            ids, sizes = bpe.encode_rows(b.column(1), end_id)
            starts = out.at + np.cumsum(sizes) - sizes
            out.add(ids.tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([part] * n, pa.int32()), pa.array([out.out.name] * n),
                 pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                names=["doc_id", "part", "file", "start_in_file", "n_tokens"])
        if out is not None:
            out.close()

    index = written(dealt.select("doc_id", "text").mapInArrow(write, INDEX.format(id=kind)), "token-index")
    # one row per file; partitions of the range exchange are in id order
    files = written(index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")), "token-files")
    before = files.select(F.col("file"), (
        F.sum("n").over(Window.orderBy("part", "file")) - F.col("n")).alias("before"))
    return index.join(before, "file").select(
        "doc_id", "part", "file", (F.col("before") + F.col("start_in_file")).alias("start"),
        "start_in_file", "n_tokens")


class SequenceFile:
    """Random access to an Arrow file of equal-length sequences, without copies."""

    def __init__(self, source, seqs: int = SEQS):
        self.reader = pa.ipc.open_file(source)
        self.seq_len = int(self.reader.schema.metadata[b"seq_len"])
        self.per_batch = self.seq_len * seqs
        self.batch = lru_cache(4)(self.reader.get_batch)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of the i-th sequence."""
        b, at = divmod(i * self.seq_len, self.per_batch)
        batch = self.batch(b)
        row = at // self.seq_len
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values

    def spans(self, start: int, n: int):
        """Views that together hold the n ids from ``start`` on."""
        while n > 0:
            b, at = divmod(start, self.per_batch)
            batch = self.batch(b)
            view = batch.column(0).values.to_numpy()[at:at + n]
            mask = batch.column(1).values.slice(at, len(view))
            if not len(view) or mask.false_count:
                raise ValueError("the index points behind the ids of its file")
            yield view
            start, n = start + len(view), n - len(view)


@contextmanager
def open_sequences(folder: str, name: str, seqs: int = SEQS):
    """A :class:`SequenceFile`; memory-mapped where the store is a mounted folder."""
    fs, base = store(folder)
    path = f"{base}/{name}"
    source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
    with source:
        yield SequenceFile(source, seqs)


def read_token_files(spark: SparkSession, folder: str, index: DataFrame, end_id: int = END_ID,
                     seqs: int = SEQS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) of every indexed document, from the files."""
    bound_batches(spark)
    rows = index.select("doc_id", "start", "n_tokens", "file", "start_in_file",
                        F.floor(F.col("start_in_file") / STRETCH).alias("stretch"))
    # the rows are small but stand for ids in files, so the number of tasks goes by those
    ids = index.agg(F.sum("n_tokens")).first()[0] or 0
    dealt = rows.repartition(1 + ids // STRETCH, "file", "stretch").sortWithinPartitions("file", "start_in_file")
    kind = index.schema["doc_id"].dataType.simpleString()

    def read(batches):
        for b in batches:
            files, starts, sizes = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(2).to_pylist()
            crcs, i = [], 0
            while i < len(files):
                j = i
                with open_sequences(folder, files[i], seqs) as f:
                    while j < len(files) and files[j] == files[i]:
                        crc, last = 0, None
                        for view in f.spans(starts[j], sizes[j]):
                            crc, last = zlib.crc32(view.astype("<u4").tobytes(), crc), int(view[-1])
                        if last != end_id:
                            raise ValueError(f"a document of {files[i]} does not end with {end_id}")
                        crcs.append(crc)
                        j += 1
                i = j
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(docs: DataFrame, path: str, **how) -> DataFrame:
    """Write ``docs`` to a new folder of token files and read every document back."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    index = write_token_files(docs, folder, path, **how)
    return read_token_files(spark, folder, index, how.get("end_id", END_ID), how.get("seqs", SEQS))
