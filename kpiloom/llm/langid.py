"""Language identification by nearest centroids of n-gram vectors.

A text is a normalised TF-IDF vector of hashed letter trigrams.  Each language has
several centroids, clustered from a bounded sample of its documents; a text takes the
language of the centroid with the largest cosine.  A text whose cosine is below what
that language's sample shows for texts of its length is rejected; length is the number
of different trigrams, so that a repeated word counts as a short text.
"""

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written
from .sampling import id_remainder, per_label_sample

#: Hashed dimensions of a vector.
DIM = 4096
#: Documents per language that the centroids are fitted on (expected number).
FIT_DOCS = 500
#: Centroids per language, and rounds of clustering.
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected if its cosine is below SHARE of the LOW quantile of the cosines that its
#: language's sample has at its length, over at least LEAST texts (neighbouring lengths join);
#: and if it is 0.  A language with fewer texts takes the limits of all languages together.
LOW, SHARE, LEAST = 0.02, 0.5, 100
#: Powers of two of the number of different trigrams.
LENGTHS = DIM.bit_length()
UNKNOWN = "und"
_CHUNK = 1 << 20
_PAIR = np.dtype([("bin", "<u2"), ("n", "<f4")])
_LETTER = regex.compile(r"\p{L}").search
#: a-z and all bytes beyond ASCII stand for themselves, capitals are lowered, the
#: rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed letter trigrams, word ends included; whole texts, in pieces."""
    data = b" " + (text if text.isascii() else text.lower()).encode().translate(_TABLE) + b" "
    out = np.zeros(DIM, np.float64)
    for i in range(0, len(data) - 2, _CHUNK):
        x = np.frombuffer(data[i:i + _CHUNK + 2], np.uint8).astype(np.uint32)
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        code = code[x[1:-1] != 32]                  # each trigram has a letter in its middle
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    return out


def excerpts(text: str) -> list[str]:
    """One stretch of the text for each power of two of its length, somewhere in it."""
    out = []
    for n in (3 << s for s in range(LENGTHS) if 3 << s < len(text)):
        at = zlib.crc32(f"{n} {text[:1000]}".encode()) % (len(text) - n)
        if _LETTER(text[at:at + n]):
            out.append(text[at:at + n])
    return out


def lengths(counts: np.ndarray) -> np.ndarray:
    """The power of two of the number of different trigrams, row by row."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(int)


def packed(counts: np.ndarray) -> bytes:
    """The bins that are not 0, with their counts."""
    out = np.zeros(np.count_nonzero(counts), _PAIR)
    out["bin"] = counts.nonzero()[0]
    out["n"] = counts[out["bin"]]
    return out.tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIM))
    for i, row in enumerate(rows):
        pairs = np.frombuffer(row, _PAIR)
        out[i, pairs["bin"]] = pairs["n"]
    return out


@dataclass
class Centroids:
    """The fitted model; ``least`` is the smallest accepted cosine by centroid and ``lengths``."""

    langs: list[str] = field(default_factory=list)        # of each centroid
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIM))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    least: np.ndarray = field(default_factory=lambda: np.zeros((0, LENGTHS)))

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        v = counts * self.idf
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n, n, 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and _LETTER(t)]
        if not rows or not self.langs:
            return out
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            counts = np.stack([trigram_counts(texts[i]) for i in part])
            cos = self.weigh(counts).astype(np.float32) @ self.vectors.T
            best = cos.argmax(axis=1)
            for i, b, c, s in zip(part, best, cos[np.arange(len(part)), best].tolist(), lengths(counts)):
                out[i] = (self.langs[b], min(1.0, max(0.0, c)), bool(c < max(self.least[b, s], 1e-6)))
        return out


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: farthest-first starts, then rounds of spherical
    k-means; ties and repeated rows fall to the first centroid."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    while len(start) < min(k, len(x)):
        near = (x @ x[start].T).max(axis=1)
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        start.append(far)
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit_language(model: Centroids, docs: list[bytes], pieces: list[list[bytes]],
                 k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, lengths, left-out cosines) of one language from its packed documents and
    their packed excerpts; lengths and cosines are of both, without a lone document's."""
    counts = unpacked(docs)
    x = model.weigh(counts).astype(np.float32)
    c = cluster(x, k)
    if len(x) < 2:
        return c, np.zeros(0, int), np.zeros(0)
    size, cos = [lengths(counts)], [left_out_cosines(x, c, x, np.arange(len(x)))]
    flat = [(i, p) for i, own in enumerate(pieces) for p in own]
    for at in range(0, len(flat), 512):
        part = flat[at:at + 512]
        counts = unpacked([p for _, p in part])
        size.append(lengths(counts))
        cos.append(left_out_cosines(model.weigh(counts).astype(np.float32), c, x,
                                    np.array([i for i, _ in part])))
    return c, np.concatenate(size), np.concatenate(cos)


def assembled(model: Centroids, fitted: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> Centroids:
    """``model`` with the (language, centroids, lengths, cosines) of its languages."""
    fitted = sorted(fitted, key=lambda f: f[0])
    model.langs = [lang for lang, c, _, _ in fitted for _ in c]
    model.vectors = np.concatenate([c for _, c, _, _ in fitted]).astype(np.float32)
    together = least_cosines(*(np.concatenate([f[i] for f in fitted]) for i in (2, 3)))
    own = [least_cosines(size, cos) if len(cos) >= LEAST else together for _, _, size, cos in fitted]
    model.least = np.stack([o for (_, c, _, _), o in zip(fitted, own) for _ in c])
    return model


def left_out_cosines(x: np.ndarray, c: np.ndarray, of: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Largest cosine of the unit rows ``x`` with the centroids ``c`` of their language, each
    measured without row ``own`` of the clustered rows ``of``, which it is or comes from."""
    member = (of @ c.T).argmax(axis=1)
    sums = np.stack([of[member == i].sum(axis=0) for i in range(len(c))])
    cos = x @ c.T
    rest = sums[member[own]] - of[own]
    norm = np.linalg.norm(rest, axis=1)
    cos[np.arange(len(x)), member[own]] = np.where(
        norm > 1e-4, (x * rest).sum(axis=1) / np.maximum(norm, 1e-4), 0)
    return cos.max(axis=1)


def least_cosines(size: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """The smallest accepted cosine of each length, from the cosines of sample texts."""
    out = np.zeros(LENGTHS)
    for s in range(LENGTHS):
        for width in range(LENGTHS):
            near = cos[abs(size - s) <= width]
            if len(near) >= min(LEAST, len(cos)):
                break
        out[s] = SHARE * np.quantile(near, LOW) if len(near) else 0
    return np.maximum.accumulate(out)           # longer texts come no less close


def fit_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             each: int = FIT_DOCS, k: int = CENTROIDS) -> Centroids:
    """Fit on about ``each`` documents per language, of those with a non-null id,
    language and text whose id remainder (crc32 modulo 4) is not 2.

    Rows that agree in id, language and text are one document.  One task fits a
    language.  The driver receives DIM document frequencies and, for each language, its
    centroids (16 KB each) and at most some 14 numbers a sample document, about 0.1 MB;
    the model, 64 KB a language, is broadcast to the Python workers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    rows = rows.where(id_remainder("doc_id", 4) != 2).where("lang is not null and text is not null")
    sample = per_label_sample(rows, "lang", ["doc_id", "text"], each)

    def vectors(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [(lang, packed(trigram_counts(t)), [packed(trigram_counts(e)) for e in excerpts(t)])
                     for lang, t in zip(langs, texts) if _LETTER(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i, kind in
                 enumerate((pa.string(), pa.binary(), pa.list_(pa.binary())))],
                names=["lang", "doc", "pieces"])

    got = written(sample.select("lang", "text").mapInArrow(
        vectors, "lang string, doc binary, pieces array<binary>").repartition("lang"), "langid-sample")
    total = got.count()
    if not total:
        return Centroids()

    def frequencies(batches):
        seen = np.zeros(DIM, np.int64)
        for b in batches:
            for doc in b.column(0).to_pylist():
                seen[np.frombuffer(doc, _PAIR)["bin"]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(DIM), pa.int32()), pa.array(seen)], names=["bin", "seen"])

    seen = np.zeros(DIM)
    for r in got.select("doc").mapInArrow(frequencies, "bin int, seen long").groupBy("bin").sum("seen").collect():
        seen[r[0]] = r[1]
    model = Centroids(idf=np.log((1 + total) / (1 + seen)) + 1)

    def fit(group: pa.Table) -> pa.Table:
        own = sorted(zip(group["doc"].to_pylist(), group["pieces"].to_pylist()))
        c, size, cos = fit_language(model, [d for d, _ in own], [p for _, p in own], k)
        return pa.table({"lang": group["lang"][:1], "centroids": pa.array([c.astype("<f4").tobytes()], pa.binary()),
                         "size": pa.array([size.tolist()], pa.list_(pa.int32())),
                         "cos": pa.array([cos.tolist()], pa.list_(pa.float32()))})

    fitted = got.groupBy("lang").applyInArrow(
        fit, "lang string, centroids binary, size array<int>, cos array<float>").collect()
    return assembled(model, [(r[0], np.frombuffer(r[1], "<f4").reshape(-1, DIM),
                              np.array(r[2], int), np.array(r[3], float)) for r in fitted])


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row.

    Texts that are null or have no letter are ``und``, score 0 and rejected; so is
    everything when the model has no language.  Null ids are neither learned from nor
    held out.  Repeated rows keep their rows; other columns are ignored; an empty
    table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(id_remainder(id_col, 4) == 2, F.lit(False)).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = held.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns unchanged."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([not r[2] for r in held.value.predict([t if isinstance(t, str) else None for t in texts])])

    return docs.where(keep(F.col(text_col).cast("string")))
