import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kpiloom.llm import bpe, token_files
from kpiloom.llm.common import scratch

from .data import awkward_documents, empty_documents

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LETTERS = ["a", "B", "é", "Σ", "ß", " ", "  ", "\n", "\x1c", " ", "'s", "'LL", "1", "２", "#", "<|endoftext|>",
           "<|startoftext|>", "ǅ", "İ", "́", "漢", "😀", "​", "᠎", "\u0085", "word", "The ", ". ", ",",
           "\t", "　", "ﬁ", " ", "Å", "\x00", "\x7f", "ª", "٣", "ͅ", "qz", "***", "%%% "]


def random_texts(n=4000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD), bpe.WordBPE(WORD, limit=50)


def test_word_ids_and_decoding_equal_the_library(word):
    lib, own = word
    for t in random_texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, repr(t)
        assert own.decode(own.encode(t)).decode() == lib.decode(ids, skip_special_tokens=False), repr(t)


def test_forced_boundaries_lie_inside_no_token(word):
    lib, own = word
    byte_of = {c: b for b, c in enumerate(bpe.byte_letters())}
    for t in list(lib.get_vocab(with_added_tokens=False))[::37]:
        assert len(own.fragments(bytes(byte_of[c] for c in t.removesuffix("</w>")))) == 1
    cut = own.fragments("naïveqzžword".encode())
    assert len(cut) > 1 and b"".join(cut) == "naïveqzžword".encode()


def test_byte_ids_equal_the_library():
    lib, own = Tokenizer.from_file(BYTE), token_files.ByteBPE(BYTE)
    for t in random_texts(seed=2):
        assert np.frombuffer(own.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_query_rows(spark, word):
    lib, _ = word
    docs = awkward_documents(spark)
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.bpe_round_trip(docs, WORD).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs, WORD), WORD)
    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in decoded.collect() if r.doc_id) == \
        sorted((w[0], w[3]) for w in want if w[0])
    assert bpe.bpe_round_trip(empty_documents(spark), WORD).count() == 0


def brute_tokens(rows):
    lib, out, start = Tokenizer.from_file(BYTE), [], 0
    for i, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_match_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = [tuple(r) for r in token_files.token_round_trip(docs, BYTE).collect()]
    assert sorted(got) == brute_tokens(rows)


def test_awkward_documents_and_small_batches(spark):
    docs = awkward_documents(spark)
    got = [tuple(r) for r in token_files.token_round_trip(docs, BYTE, seq_len=16, seqs=4).collect()]
    lib = Tokenizer.from_file(BYTE)
    want = {}
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have, at = {}, 0
    for i, start, n, crc in sorted(got, key=lambda g: g[1]):
        assert start == at                                  # gapless
        at += n
        have.setdefault(i, []).append((n, crc))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.token_round_trip(empty_documents(spark), BYTE).count() == 0


def test_sequences_are_random_access_views(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    folder = scratch(spark, "tokens-test")
    index = token_files.write_token_files(docs, folder, BYTE, seq_len=64, seqs=8)
    files = {r.file: r.n for r in index.groupBy("file").agg({"n_tokens": "sum"}).toDF("file", "n").collect()}
    for name, n in files.items():
        with token_files.open_sequences(folder, name, seqs=8) as f:
            before = pa.total_allocated_bytes()
            rows = [f.sequence(i) for i in range(-(-n // 64))]
            assert pa.total_allocated_bytes() == before     # views of the mapped file
            assert all(len(ids) == 64 == len(mask) for ids, mask in rows)
            assert sum(mask.true_count for _, mask in rows) == n
            with pytest.raises(ValueError):
                list(f.spans(n - 1, 2))
            del rows


def differing(lib, own, texts):
    encoded = lib.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, encoded) if np.frombuffer(own.encode(t), "<u4").tolist() != e.ids]


def test_word_ids_equal_the_library_on_every_script(word):
    lib, own = word
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3400 or 0xA000 <= c < 0xAC00
              or 0xF900 <= c < 0x11000 or c % 41 == 0)]
    for form in ("a{}b", "!{}!", "{} {}"):
        assert differing(lib, own, [form.replace("{}", chr(c)) for c in points]) == []


def test_word_ids_equal_the_library_on_runs_of_marks(word):
    lib, own = word
    rng = random.Random(3)
    marks = [chr(c) for a, b in ((0x300, 0x370), (0x1AB0, 0x1ACF), (0x1DC0, 0x1E00), (0x20D0, 0x20F1)) for c in range(a, b)]
    texts = ["".join(rng.choice(["a", "İ", "I", "ོ", " ", *marks]) for _ in range(rng.randint(1, 8))) for _ in range(8000)]
    assert differing(lib, own, texts) == []


def test_unbroken_megabyte(word):
    lib, own = word
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij") for _ in range(1 << 20))
    assert differing(lib, own, [text, text[:1000] + "é" + text[:1000]]) == []
    assert max(map(len, own.pieces)) <= bpe.LONGEST and len(own.pieces) <= 50
