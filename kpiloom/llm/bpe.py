"""Byte-pair encoding with forced boundaries, and decoding.

A merge can only join two byte runs that stand side by side inside some vocabulary
token.  A pair of neighbouring bytes that occurs inside no token is therefore a
certain cut: no merge ever crosses it.  White space occurs inside no token of the
word vocabulary, so a text is first cut there; each piece is cut at its remaining
forced boundaries, the fragments are encoded independently of each other, and
their ids are concatenated.  Equal pieces are encoded once per worker, within a
bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .common import bound_batches

#: Pieces held by each of the two generations of a worker's cache, and the longest
#: piece held: together they bound the cache in bytes, whatever the corpus.
CACHED = 250_000
LONGEST = 64
#: Latin text, on which Python and the library agree in lower case, letters and
#: digits, and which is its own composed form; all other text is normalised and split
#: by the library itself, whose Unicode tables are of another version.
_LATIN = re.compile("[\x00-\u024f]*").fullmatch
#: White space of Latin text; Python's own ``split`` also cuts at the four characters 1C
#: to 1F, which the library does not take for white space.
_SPACE = re.compile("[\t-\r \x85\xa0]+")
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes for themselves, the others for 256, 257, ... in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PieceCache(dict):
    """piece -> encoded ids in two generations of bounded size: pieces in use move
    to the young one, the old one is dropped when the young one is full.  Pieces
    longer than ``LONGEST`` characters are never held."""

    def __init__(self, encode, limit: int = CACHED):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        if len(piece) > LONGEST:
            return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class WordBPE:
    """Encoder and decoder of a word-end BPE vocabulary file (NFC, white space
    dropped, lower case, byte-level letters, ``</w>`` on a word's last symbol)."""

    def __init__(self, path: str, limit: int = CACHED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = vocab | self.special
        self.text = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.text[i] = t.encode()
        self.last = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix)
        self.inner = models.BPE(vocab=vocab, merges=merges)
        letters = byte_letters()
        self.letters = letters
        byte_of = {c: b for b, c in enumerate(letters)}
        inside = {pair for t in vocab for pair in pairwise(map(byte_of.__getitem__, t.removesuffix(suffix)))}
        every = range(256)
        self.forced = {(a, b) for a in every for b in every} - inside   # never side by side in a token
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.latin_words = regex.compile(split).findall
        library = Tokenizer.from_file(path)
        self.library_form, self.library_words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = PieceCache(self.encode_piece, limit)

    def fragments(self, word: bytes) -> list[bytes]:
        """``word`` cut at its forced boundaries."""
        if self.forced.isdisjoint(pairwise(word)):
            return [word]
        cuts = [i for i, pair in enumerate(pairwise(word), 1) if pair in self.forced]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]

    def encode_piece(self, piece: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of text without white space."""
        if not (piece.isascii() and piece.isalpha()):
            words = self.words(piece)
            if words != [piece]:
                return b"".join(map(self.pieces.__getitem__, words))
        *parts, end = self.fragments(piece.encode())
        ids = [t.id for f in parts for t in self.inner.tokenize(self._letters(f))]
        ids += [t.id for t in self.last.tokenize(self._letters(end))]
        return array("I", ids).tobytes()

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of text without white space."""
        if _LATIN(piece):
            return self.latin_words(piece)
        return [piece[i:j] for _, (i, j) in self.library_words(piece)]

    def _letters(self, data: bytes) -> str:
        return data.decode() if data.isalnum() else "".join(map(self.letters.__getitem__, data))

    def normalised(self, text: str) -> list[str]:
        """The pieces of a text between white space, in lower case and composed form."""
        if not _LATIN(text):
            return [p for p in self.library_form(text).split(" ") if p]
        text = text.lower()
        if "\u0307" in text:                # of a dotted capital I, the one letter of another form
            return [p for p in self.library_form(text).split(" ") if p]
        return [p for p in _SPACE.split(text) if p] if _NOT_SPACE.search(text) else text.split()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.marks is not None and "<|" in text and self.marks.search(text):
            return b"".join(
                np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p)
                for p in self.marks.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.normalised(text)))

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: this vocabulary has no decoder of its own, so
        its tokens stand as they are, special ones too, with spaces between them."""
        return b" ".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    """One encoder per worker process: its cache serves all tasks the worker runs."""
    return WordBPE(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) of every row; see :func:`bpe_round_trip` for the cases."""
    rows = _texts(docs, id_col, text_col)

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids binary); null ids decode to an empty text."""
    bound_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "ids")

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            texts = [bpe.decode(i or b"") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null and empty texts have no tokens and an empty decoded text.  Every row is
    encoded by itself: repeated rows and null ids keep their rows, other columns
    are ignored, an empty table gives no rows, long texts go through piece by piece.
    """
    rows = _texts(docs, id_col, text_col)

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            n, sha, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(
        run, f"doc_id {_id_type(rows)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
