"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

#: Columns whose names operators use for their own results.
CLASH = ("id", "fp", "component", "size", "shard", "slot", "h", "t", "start", "rank", "score", "failed")


def awkward_documents(spark, seed: int = 5):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(seed)
    vocab = ["the", "of", "Und", "der", "naïve", "ÉTÉ", "x", "word,", "漢字", "it's", "a1", "***", "Σίσυφος"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = text(60)
    rows = [
        (1, None, "en", "b"), (2, "", None, "b"), (3, " \t\n ", "en", None), (4, "Word", "en", "a"),
        (5, "two words", "de", "a"), (6, base, "en", "a"), (7, base, "en", "b"), (7, base, "en", "b"),
        (8, base + " tail", None, "é"), (None, base, "en", "a"), (None, text(5), None, None),
        (9, text(30000), "en", "a"), (10, base.replace("the", "of", 1), "fr", "c"),
        (11, "line one\nline two\n\nline one\n", "en", "c"), (12, "a  b c d <|endoftext|> e ", "fr", "c"),
        (13, "x" * 5000, "en", "c"), (-4, "negative id, other text here", "de", "z"),
    ] + [(100 + i, text(rng.randint(1, 40)), rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(30)]
    clash = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1]), *("clash" for _ in CLASH)) for r in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {clash}")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def components(n: int, linked) -> list[int]:
    """For each of n nodes the smallest node connected with it, by plain search."""
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(n)]
