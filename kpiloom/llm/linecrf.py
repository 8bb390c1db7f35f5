"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad from its own features, those of the
lines beside it, and the labels beside it.  A document's quality is the mean of the
lines' forward-backward marginals, weighted by line length.
"""

import zlib
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written
from .sampling import id_remainder, per_label_sample

#: Labelled documents per class that the model is fitted on (expected number), and the
#: lines that are taken of each, in one stretch somewhere in it.
FIT_DOCS = 1200
FIT_LINES = 400
#: Score from which a document counts as good (fixed by contract).
GOOD_FROM = 0.3
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(65, 91))
_LETTERS, _DIGITS, _POINTS = _UPPER + bytes(range(97, 123)), b"0123456789", b"!?.,;:"
OWN = 18


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a text; an empty text is one empty line."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    rows, last = [], None
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            rows.append((1.0,) + (0.0,) * (OWN - 1))
            last = None
            continue
        chars = len(line.translate(None, _SPACES))
        count = lambda drop: len(line) - len(line.translate(None, drop))
        symbols, upper, letters = count(_SYMBOLS), count(_UPPER), count(_LETTERS)
        bangs, digits, points = line.count(b"!"), count(_DIGITS), count(_POINTS)
        fresh = len(set(words)) / n
        again = sum(map(eq, words, words[1:])) / n
        caps = upper / letters if letters else 0.0
        rows.append((
            0.0, min(n, 100) / 100, 1.0 if n < 4 else 0.0, symbols / chars,
            1.0 if 10 * symbols > n else 0.0, min(1.0, bangs / n), 1.0 if 2 * bangs > n else 0.0, caps,
            1.0 if caps > 0.5 and letters > 3 else 0.0, digits / chars, fresh if n > 4 else 1.0,
            1.0 if n > 4 and fresh < 0.5 else 0.0, again, 1.0 if n > 2 and again > 0.3 else 0.0,
            min(1.0, line.count(b"|") / n), min(chars / n, 20) / 20, points / chars,
            1.0 if line == last or line in seen else 0.0))
        seen.add(line)
        last = line
    return np.array(rows, np.float32), np.array([len(x) + 1 for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """A bias, a line's own features, and those of the lines before and after it."""
    n = len(own)
    out = np.zeros((n, 1 + 3 * OWN), np.float32)
    out[:, 0] = 1
    out[:, 1:1 + OWN] = own
    out[1:, 1 + OWN:1 + 2 * OWN] = own[:-1]
    out[:-1, 1 + 2 * OWN:] = own[1:]
    return out


class Chains:
    """Chains of lines laid out for steps over all of them at once, longest first."""

    def __init__(self, sizes: list[int]):
        sizes = np.asarray(sizes, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[order], sizes[order]
        self.longest = int(self.sizes[0]) if len(sizes) else 0
        # active[t]: how many chains have a line t
        self.active = len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(self.longest), side="right")

    def rows(self, t: int) -> np.ndarray:
        return self.starts[:self.active[t]] + t


def forward_backward(chains: Chains, good: np.ndarray, moves: np.ndarray):
    """(marginals, pair sums, log partition sum) of two-state chains; state 1 is good and has
    score ``good`` per line, state 0 has score 0; ``moves`` are log transition scores."""
    n = len(good)
    e = np.stack([np.zeros(n), good], axis=1)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    into = lambda x, m: np.logaddexp(x[:, :1] + m[0], x[:, 1:] + m[1])
    for t in range(chains.longest):
        at = chains.rows(t)
        a[at] = e[at] if t == 0 else into(a[at - 1], moves) + e[at]
    for t in range(chains.longest - 2, -1, -1):
        at = chains.rows(t)[:chains.active[t + 1]]
        b[at] = into(b[at + 1] + e[at + 1], moves.T)
    total = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    marginal = np.exp(a[:, 1] + b[:, 1] - total)
    pairs = np.zeros((2, 2))
    inner = np.concatenate([chains.rows(t) for t in range(1, chains.longest)]) if chains.longest > 1 else []
    if len(inner):
        nxt = e[inner] + b[inner]
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = np.exp(a[inner - 1, i] + moves[i, j] + nxt[:, j] - total[inner]).sum()
    return marginal, pairs, total[chains.starts].sum() if n else 0.0


@dataclass
class LineCRF:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + 3 * OWN))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def score(self, texts: list[bytes]) -> list[float]:
        """Quality of each text, from 0 to 1."""
        out: list[float] = []
        held, size = [], 0
        for text in texts:
            held.append(line_features(text))
            size += len(held[-1][1])
            if size > 20_000:
                out += self._score(held)
                held, size = [], 0
        return out + (self._score(held) if held else [])

    def _score(self, held) -> list[float]:
        sizes = [len(n) for _, n in held]
        good = np.concatenate([with_neighbours(f) @ self.weights for f, _ in held])
        p, _, _ = forward_backward(Chains(sizes), good, self.moves)
        length = np.concatenate([n for _, n in held])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        got = np.add.reduceat(p * length, at) / np.add.reduceat(length, at)
        return np.clip(got, 0, 1).tolist()


def fit_crf(sample: list[tuple[int, np.ndarray]], steps: int = STEPS) -> LineCRF:
    """Fit on (label, own features of the lines) rows by gradient steps on the
    penalised likelihood; every line of a sampled document has the document's label.
    Without both labels the model is indifferent: it scores 0.5."""
    sample = sorted(sample, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    if len({label for label, _ in sample}) < 2:
        return LineCRF()
    x = np.concatenate([with_neighbours(f) for _, f in sample])
    sizes = [len(f) for _, f in sample]
    label = np.repeat([float(y) for y, _ in sample], sizes)
    # each document counts alike, whatever its number of lines
    weight = np.repeat(1 / np.asarray(sizes, float), sizes)
    chains, model = Chains(sizes), LineCRF()
    stay = sum(max(0, s - 1) for s in sizes) or 1
    seen = np.zeros((2, 2))
    for y, f in sample:
        seen[y, y] += len(f) - 1
    params = np.concatenate([model.weights, np.zeros(4)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, moves = params[:-4], params[-4:].reshape(2, 2)
        p, pairs, _ = forward_backward(chains, x @ w, moves)
        grad = np.concatenate([x.T @ ((label - p) * weight) / len(sizes) - RIDGE * w,
                               ((seen - pairs) / stay - 0.1 * moves).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        params += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return LineCRF(params[:-4], params[-4:].reshape(2, 2))


def stretch(rows: np.ndarray, text: bytes, most: int) -> np.ndarray:
    """``most`` rows in a row at most, from a place drawn by the text."""
    if len(rows) <= most:
        return rows
    at = zlib.crc32(text) % (len(rows) - most + 1)
    return rows[at:at + most]


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", each: int = FIT_DOCS, most_lines: int = FIT_LINES) -> LineCRF:
    """Fit on about ``each`` documents per class, of those labelled 0 or 1 whose id
    remainder (crc32 modulo 5) is not 0, and on a stretch of ``most_lines`` lines of
    those that have more.

    The labels are joined to the documents by id; rows that agree in id, label and
    text are one document, an id under many texts as many.  One executor task fits the
    model from the stretches' features (29 KB a document at most); the driver
    receives its weights alone.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(id_remainder("id", 5) != 0).where("label in (0, 1)")
    # twice: of the labels, so that few ids meet the documents, and of the documents found
    # by them, so that an id under many texts can't swell the sample
    chosen = written(per_label_sample(known, "label", ["id"], each), "quality-labels")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = written(rows.join(chosen, "id").select("id", "label", "text"), "quality-documents")
    rows = per_label_sample(rows, "label", ["id", "text"], each).select("label", "text")

    def features(batches):
        for b in batches:
            out = [(y, stretch(line_features(t)[0], t, most_lines))
                   for y, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for y, _ in out], pa.int32()), pa.array([f.tobytes() for _, f in out], pa.binary())],
                names=["label", "features"])

    def fit(sample: pa.Table) -> pa.Table:
        model = fit_crf([(y, np.frombuffer(f, np.float32).reshape(-1, OWN)) for y, f in
                         zip(sample["label"].to_pylist(), sample["features"].to_pylist())])
        return pa.table({"weights": [model.weights.tolist()], "moves": [model.moves.ravel().tolist()]})

    sample = rows.mapInArrow(features, "label int, features binary").withColumn("all", F.lit(0))
    fitted = sample.groupBy("all").applyInArrow(
        fit, "weights array<double>, moves array<double>").collect()
    if not fitted:
        return LineCRF()
    return LineCRF(np.array(fitted[0][0]), np.array(fitted[0][1]).reshape(2, 2))


def score_quality(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as one empty line.  Null ids are neither learned
    from nor held out.  Repeated rows keep their rows; other columns are ignored; an
    empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(id_remainder(id_col, 5) == 0, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = model.score(b.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


def accepted(docs: DataFrame, model: LineCRF, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, columns unchanged."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([t.encode() if isinstance(t, str) else b"" for t in texts]))

    return docs.where(score(F.col(text_col).cast("string")) >= GOOD_FROM)
