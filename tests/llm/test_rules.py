import random
import re
from collections import Counter

from kpiloom.llm import rules

from .data import awkward_documents, empty_documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    inside = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def test_measurements_match_brute_force(spark):
    docs = awkward_documents(spark)
    rows = rules.ledger(docs).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)


def test_random_texts():
    rng = random.Random(2)
    for _ in range(400):
        parts = [rng.choice(["a", "b", "é", "#", "\n", " ", "\t", "漢 ", "a b a b a b a b ", "\x1c"]) for _ in range(rng.randint(0, 60))]
        text = "".join(parts)
        n, chars, symbols, _, dup, again = rules.measure(text.encode())
        assert (n, chars, symbols, dup, again) == brute(text)


def test_every_rule_has_its_bit_and_policies_are_masks(spark):
    texts = ["few words", "a b c d e f g h " * 20, "word #### " * 30 + " ".join(map(str, range(99))),
             "\n".join(["same line again"] * 3 + [f"line {i}" for i in range(40)]),
             "a " * 3 + " ".join(str(i % 10) for i in range(40)), " ".join("x" * 30 + str(i) for i in range(40)),
             " ".join(f"clean{i}" for i in range(50)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rules.ledger(df)
    masks = {r.doc_id: r.failed for r in rows.collect()}
    names = [n for n, _ in rules.RULES]
    bit = lambda n: 1 << names.index(n)
    assert masks[0] == bit("too_few_words") and masks[7] == masks[0]
    assert masks[1] & bit("repeated_words") and masks[2] & bit("many_symbols")
    assert masks[4] & bit("short_words") and masks[5] == bit("long_words") and masks[6] == 0
    for policy in rules.POLICIES.values():
        kept = {r.doc_id: r.kept for r in rules.apply_policy(rows, policy).collect()}
        assert kept == {i: not m & policy.mask for i, m in masks.items()}
        for r in rules.ablations(rows, policy).collect():
            b = bit(r.rule)
            live = [m & policy.mask for m in masks.values()]
            assert r.failed == sum(bool(m & b) for m in live)
            assert r.only == sum(m == b for m in live)
            assert r.kept_without == sum(not m & ~b for m in live)


def test_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = rules.apply_policy(rules.ledger(spark.read.parquet(f"{d}/documents.parquet")), rules.POLICIES[rules.CURRENT])
    got = rows.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("n_words >= 20")
    good = got.where("quality = 1")
    assert good.where("kept").count() >= 0.99 * good.count()
    bad = got.where("quality = 0")
    assert bad.where("not kept").count() >= 0.9 * bad.count()


def test_empty_table(spark):
    rows = rules.ledger(empty_documents(spark))
    assert rows.count() == 0 and rules.ablations(rows, rules.POLICIES["v2"]).count() == 0


def test_one_measurement_serves_all_policies(spark):
    """The stored ledger's readers scan numbers: no Python evaluation is left in their plans."""
    rows = rules.stored_ledger(awkward_documents(spark))
    for df in (*(rules.apply_policy(rows, p) for p in rules.POLICIES.values()),
               rules.ablations(rows, rules.POLICIES[rules.CURRENT])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan and "FileScan parquet" in plan
    assert rows.count() == awkward_documents(spark).count()
