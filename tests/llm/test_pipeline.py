"""The pipeline against plain versions of its stages, and the registered queries."""

import hashlib
import importlib.util
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from kpiloom.llm import langid, linecrf, mixing

from .data import awkward_documents, empty_documents
from .test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs))
        docs = stage(spark, docs, SF).cache()
    return dict([*out, ("result", docs)])


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_filters_keep_what_their_models_accept(spark, stages):
    docs = stages["language"]
    model = langid.fit_from(docs)
    want = [r.doc_id for r in docs.collect() if not model.predict([r.text])[0][2]]
    assert ids(stages["quality"]) == sorted(want)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    crf = linecrf.fit_from(stages["quality"], labels)
    want = [r.doc_id for r in stages["quality"].collect() if crf.score([r.text.encode()])[0] >= 0.3]
    assert ids(stages["near_duplicates"]) == sorted(want)
    for name in ("quality", "near_duplicates", "mixing", "encoding"):
        assert stages[name].columns == docs.columns


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["near_duplicates"].collect()]
    assert ids(stages["mixing"]) == sorted({c for _, _, c in brute_groups(rows)})


def test_mix_takes_effect(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(stages["mixing"]).collect()}
    got = Counter()
    for r in stages["encoding"].collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == +Counter(taken)


def test_result_is_the_library_encoding(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in stages["encoding"].collect():
        e = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, stages["result"].collect())) == sorted(want)


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["result"].collect()))


@pytest.mark.parametrize("make", [awkward_documents, empty_documents])
def test_stages_take_awkward_and_empty_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, make(spark), SF)
        assert docs.columns == make(spark).columns and docs.count() <= 3 * make(spark).count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, make(spark), SF).count() == make(spark).count()


SQL = [n for n in __spark_entry__.oracle_sql() if re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())


def test_contract_columns(spark):
    want = {
        "op1": "doc_id bigint, fingerprint string, component_id bigint",
        "op2": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        "op3": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op4": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op5": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op6": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
               "n_repeat_words bigint, base_failed boolean, kept boolean",
        "op7": "doc_id bigint, held_out boolean, score double, predicted int",
        "op8": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op9": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op10": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op11": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                "negative_score bigint",
        "op12": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
                "offset bigint",
        "op13": "item_id bigint, rank int, doc_id bigint, score bigint"}
    named = {n.split("_")[0]: f for n, f in __spark_entry__.queries().items() if re.match(r"op\d+_", n)}
    assert sorted(named) == sorted(want)
    for op, fields in want.items():
        types = dict(named[op](spark, SF).dtypes)
        for f in fields.split(", "):
            name, kind = f.split(" ")
            assert types[name] == kind, (op, name)


def test_nothing_else_imports_the_subpackage():
    root = importlib.util.find_spec("kpiloom").submodule_search_locations[0]
    import pathlib
    for p in pathlib.Path(root).rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
