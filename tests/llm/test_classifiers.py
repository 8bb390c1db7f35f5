import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.llm import langid, linecrf, sampling

from .data import awkward_documents, empty_documents

SF = "/root/testdata/sf0.01"


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    sizes = [3, 1, 5, 2, 1]
    good, moves = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    p, pairs, total = linecrf.forward_backward(linecrf.Chains(sizes), good, moves)
    at, want_pairs, want_total = 0, np.zeros((2, 2)), 0.0
    for n in sizes:
        g = good[at:at + n]
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.exp([sum(g[i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)) for y in paths])
        z = weight.sum()
        want = [sum(w for w, y in zip(weight, paths) if y[i]) / z for i in range(n)]
        assert np.allclose(p[at:at + n], want)
        for w, y in zip(weight, paths):
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += w / z
        want_total += np.log(z)
        at += n
    assert np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = linecrf.fit_from(docs, labels)
    got = linecrf.score_quality(docs, model)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.97 * held.count()
    # the same rows in other partitions give the same model and scores
    again = linecrf.fit_from(docs.repartition(5), labels.repartition(3))
    assert np.allclose(model.weights, again.weights)
    kept = linecrf.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()


def test_quality_is_not_learned_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality"))
        .otherwise(F.col("quality")))
    assert np.allclose(linecrf.fit_from(docs, labels).weights, linecrf.fit_from(docs, wrong).weights)


def test_quality_of_awkward_documents(spark):
    docs = awkward_documents(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).union(
        spark.createDataFrame([(None, 1), (6, None), (7, 5), (999999, 1)], "doc_id long, quality int"))
    got = linecrf.score_quality(docs, linecrf.fit_from(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    empty = [r.score for r in got if r.doc_id in (1, 2)]
    assert empty[0] == empty[1]
    blank = linecrf.fit_from(docs, labels.where("quality = 1"))
    assert {round(r.score, 6) for r in linecrf.score_quality(docs, blank).collect()} == {0.5}
    assert linecrf.score_quality(empty_documents(spark), blank).count() == 0
    assert linecrf.fit_from(empty_documents(spark), labels.where("false")).weights.any() == False  # noqa: E712


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_from(docs)
    got = langid.identify(docs, model)
    held = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert got.where("rejected").count() <= 0.002 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0
    again = langid.fit_from(docs.repartition(7))
    assert again.langs == model.langs and np.allclose(again.vectors, model.vectors)
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("not rejected").count()
    # text unlike any learned language is rejected, short known text is not
    far, near = model.predict(["Ж" * 400 + " ыъ" * 300, "the of and"])
    assert far[2] and far[0] in model.langs and not near[2]
    # several centroids per language
    assert len(model.langs) > len(set(model.langs)) > 1


def test_languages_of_awkward_documents(spark):
    docs = awkward_documents(spark).union(spark.createDataFrame(
        [(500, "12 34 !?", "en", None, 8, *["c"] * 12), (501, "Ж" * 400 + " " + "ы" * 300, None, None, 9, *["c"] * 12)],
        awkward_documents(spark).schema))
    model = langid.fit_from(docs)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(docs, model).collect() if r.doc_id is not None}
    for i in (1, 2, 3, 500):
        assert (i, "und", True) in got
    assert {lang for _, lang, _ in got} <= {"en", "de", "fr", "und"}
    assert langid.identify(empty_documents(spark), model).count() == 0
    nothing = langid.fit_from(empty_documents(spark))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


#: Prose in unlearned languages that share the letters of the learned ones.
FOREIGN = [
    "Vaka vanha Väinämöinen itse tuon sanoiksi virkkoi: mieleni minun tekevi, aivoni ajattelevi "
    "lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan.",
    "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud "
    "mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és "
    "lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "Gizon-emakume guztiak aske jaiotzen dira, duintasun eta eskubide berberak dituztela; eta "
    "ezaguera eta kontzientzia dutenez gero, elkarren artean senide legez jokatu beharra dute.",
]


def test_foreign_prose_and_random_letters_are_rejected(spark):
    model = langid.fit_from(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = np.random.default_rng(9)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(200))
    texts = [t[at:at + 100] for t in (*FOREIGN, noise) for at in range(0, len(t) - 99, 25)]
    texts += [*FOREIGN, noise] + [t * 50 for t in FOREIGN]
    assert all(rejected for _, _, rejected in model.predict(texts))


def test_learned_languages_are_not_rejected_at_any_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_from(docs)
    held = [r.text for r in docs.where(langid.id_remainder("doc_id", 4) == 2).collect() if r.text]
    pieces = [t[:n] for t in held for n in (100, 200, 400, 800, 1 << 20)] + ["to " * 500, "the der que"]
    assert sum(rejected for _, _, rejected in model.predict(pieces)) <= 0.005 * len(pieces)


def test_left_out_rows_do_not_count_for_themselves():
    rng = np.random.default_rng(3)
    x = rng.random((40, langid.DIM)) * (rng.random((40, langid.DIM)) < 0.02)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.cluster(x, 2)
    member = (x @ c.T).argmax(axis=1)
    for i, cos in enumerate(langid.left_out_cosines(x, c, x, np.arange(len(x)))):
        best = []
        for j in range(len(c)):
            rows = [x[n] for n in range(len(x)) if member[n] == j and n != i]
            mean = np.sum(rows, axis=0) if j == member[i] and rows else c[j] * (j != member[i])
            best.append(x[i] @ mean / max(np.linalg.norm(mean), 1e-12))
        assert np.isclose(cos, max(best))


def test_many_languages_fit_within_a_small_driver_result(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.pmod("id", F.lit(40)).cast("string")).alias("lang"))
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.substring(
        F.translate(F.md5(F.concat_ws(" ", "lang", F.pmod(F.xxhash64("doc_id", i), F.lit(30)))), "0123456789", "ghijklmnop"), 1, 6))
    docs = docs.withColumn("text", F.array_join(words, " "))
    jvm = spark.sparkContext._jsc.sc().conf()
    before = jvm.get("spark.driver.maxResultSize", "1g")
    jvm.set("spark.driver.maxResultSize", "1m")           # the sampled vectors, compressed, are more
    try:
        model = langid.fit_from(docs)
    finally:
        jvm.set("spark.driver.maxResultSize", before)
    assert len(set(model.langs)) == 40
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred and not rejected").count() >= 0.98 * got.count()


def test_a_thousand_languages(spark):
    docs = spark.range(12_000).select(
        F.col("id").alias("doc_id"), F.format_string("l%04d", F.pmod("id", F.lit(1000))).alias("lang"))
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.substring(F.translate(F.md5(F.concat_ws(
        " ", "lang", F.pmod(F.xxhash64("doc_id", i), F.lit(25)))), "0123456789", "ghijklmnop"), 1, 7))
    docs = docs.withColumn("text", F.array_join(words, " "))
    model = langid.fit_from(docs, k=1)
    assert len(model.langs) == 1000
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_samples_stay_bounded(spark):
    """Neither a repeated row nor an id under many texts swells a sample."""
    docs = spark.range(100_000).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.union(spark.range(50_000).select(F.lit(8).cast("long"), F.lit("a"), F.lit("one text")))
    got = sampling.per_label_sample(docs, "lang", ["doc_id", "text"], 300)
    assert got.count() <= 400 and got.columns == docs.columns
    assert got.where("doc_id = 8").count() <= 1
    few = sampling.per_label_sample(docs.where("doc_id = 8").limit(50), "lang", ["doc_id", "text"], 300)
    assert few.count() == 1
    with_null = spark.createDataFrame([(1, None, "x"), (None, "a", None)], "doc_id long, lang string, text string")
    assert [r.lang for r in sampling.per_label_sample(with_null, "lang", ["doc_id", "text"], 5).collect()] == ["a"]


def test_predictions_equal_brute_force(spark):
    """Cosines by plain dictionaries of trigrams, against the fitted centroids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_from(docs)
    for text in [r.text for r in docs.limit(12).collect() if r.text] + ["the of and", "é", "x1y"]:
        low = text if text.isascii() else text.lower()
        data = b" " + bytes(langid._TABLE[b] for b in low.encode()) + b" "
        counts = {}
        for i in range(len(data) - 2):
            if data[i + 1] != 32:
                code = (data[i] << 16) | (data[i + 1] << 8) | data[i + 2]
                b = ((code * 2654435761) & 0xFFFFFFFF) >> 20
                counts[b] = counts.get(b, 0) + 1
        norm = sum((n * model.idf[b]) ** 2 for b, n in counts.items()) ** 0.5
        cosines = [sum(n * model.idf[b] * c[b] for b, n in counts.items()) / norm for c in model.vectors]
        best = int(np.argmax(cosines))
        (lang, score, rejected), = model.predict([text])
        assert lang == model.langs[best] and score == pytest.approx(cosines[best], abs=1e-5)
        limit = max(model.least[best, int(np.log2(len(counts)))], 1e-6)
        assert rejected == (score < limit) or abs(score - limit) < 1e-5


def test_quality_scores_equal_brute_force(spark):
    """Length-weighted marginals by enumeration of all labellings."""
    rng = np.random.default_rng(2)
    model = linecrf.LineCRF(rng.normal(size=1 + 3 * linecrf.OWN), rng.normal(size=(2, 2)))
    for text in [b"One two three.\nFOUR!! five|six\n\nseven 8 9", b"", b"a\na\na", b"### $$$"]:
        lines = text.split(b"\n")
        own = linecrf.line_features(text)[0]
        zero = np.zeros(linecrf.OWN)
        good = [model.weights @ np.concatenate([[1], own[i], own[i - 1] if i else zero,
                                                own[i + 1] if i + 1 < len(lines) else zero]) for i in range(len(lines))]
        total = marginal = 0
        for y in itertools.product((0, 1), repeat=len(lines)):
            w = np.exp(sum(g for g, k in zip(good, y) if k) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            total, marginal = total + w, marginal + w * np.array(y)
        length = np.array([len(x) + 1 for x in lines])
        want = (marginal / total) @ length / length.sum()
        assert model.score([text]) == pytest.approx([want], abs=1e-6)


def test_long_documents_are_fitted_by_a_stretch(spark):
    docs = spark.createDataFrame(
        [(i, "\n".join(["good words stand in this line"] * 900 if i % 2 else ["### $$$ ||| !!!"] * 900)) for i in range(30)]
        + [(100, "x " * 300_000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = linecrf.fit_from(docs, labels, most_lines=50)
    got = {r.doc_id: r.predicted for r in linecrf.score_quality(docs, model).collect()}
    assert all(got[i] == i % 2 for i in range(30))
    rows = np.arange(1000).reshape(-1, 1)
    part = linecrf.stretch(rows, b"any text", 50)
    assert len(part) == 50 and (np.diff(part[:, 0]) == 1).all() and linecrf.stretch(rows, b"", 1000) is rows
