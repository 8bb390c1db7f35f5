import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kpiloom.llm import packing, token_files

from .data import awkward_documents, empty_documents

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def whole(docs, pieces, seq_len):
    """Pieces make up every document, and sequences are full or a power of two long."""
    lib = Tokenizer.from_file(BYTE)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"))
    rows = pieces.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in rows:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert by_doc.keys() == want.keys()
    for i, texts in want.items():
        # rows that share an id: each piece belongs to one of them, and each id of each to one piece
        spans = defaultdict(list)
        for p in by_doc[i]:
            fits = [k for k, t in enumerate(texts) if len(t) == p.doc_tokens
                    and zlib.crc32(t[p.start:p.start + p.length].tobytes()) == p.ids_crc32]
            assert fits
            spans[fits[0]].append((p.start, p.length))
        assert sum(p.length for p in by_doc[i]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length in sorted(spans[0]):
                assert start == at and length > 0
                at += length
    assert sorted(by_seq) == list(range(len(by_seq)))
    for held in by_seq.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= seq_len and at & (at - 1) == 0
    return by_seq


def test_pieces_are_whole_and_nothing_is_padded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seqs = whole(docs, packing.pack_documents(docs, BYTE), 1024)
    full = sum(sum(p.length for p in s) == 1024 for s in seqs.values())
    assert len(seqs) - full <= 10                       # one task's end, cut at powers of two


def test_awkward_documents(spark):
    docs = awkward_documents(spark)
    whole(docs, packing.pack_documents(docs, BYTE, seq_len=64), 64)
    assert packing.pack_documents(empty_documents(spark), BYTE).count() == 0
    only_windows = spark.createDataFrame([(1, "the " * 127)], "doc_id long, text string")
    assert sum(r.length for r in packing.pack_documents(only_windows, BYTE, seq_len=64).collect()) == \
        len(Tokenizer.from_file(BYTE).encode("the " * 127).ids) + 1
    with pytest.raises(ValueError):
        packing.pack_documents(docs, BYTE, seq_len=100)


def test_many_shards_and_a_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    monkeypatch.setattr(packing, "PER_TASK", 64)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, "copy of one text " * 9 if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 60))))
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole(docs, packing.pack_documents(docs, BYTE, seq_len=128), 128)


def test_neighbours_equal_brute_force_bm25():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 30, 40)
    ids = rng.integers(0, 50, counts.sum()).astype("<u2")
    idf, mean = rng.random(50), counts.mean()
    shard = packing.Shard(ids, counts, idf, mean)
    texts = np.split(ids, np.cumsum(counts)[:-1])
    seed = texts[7]
    shard.take(7, int(counts[7]))
    score = []
    for t in texts:
        s = 0.0
        for term in set(seed.tolist()):
            tf = (t == term).sum()
            s += idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(t) / mean))
        score.append(s)
    want = sorted((i for i in range(40) if i != 7 and score[i] > 0), key=lambda i: (-score[i], i))
    assert shard.neighbours(seed).tolist() == want[:packing.NEIGHBOURS]


def test_windows_hold_related_documents(spark):
    """Documents of a topic share windows far more often than chance would have it."""
    rng = random.Random(5)
    words = sorted(w[1:] for w in Tokenizer.from_file(BYTE).get_vocab() if w[0] == "\u0120" and w[1:].isalpha() and len(w) > 6)
    topics = [words[40 * k:40 * k + 40] for k in range(10)]
    rows = [(10 * i + k, " ".join(rng.choices(topics[k], k=12))) for i in range(40) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = defaultdict(set)
    for p in packing.pack_documents(docs, BYTE, seq_len=256).collect():
        held[p.sequence_id].add(p.doc_id)
    pairs = [(a % 10 == b % 10) for s in held.values() for a in s for b in s if a < b]
    assert sum(pairs) > 0.5 * len(pairs)                # by chance a tenth


def test_a_whole_batch_is_encoded_as_the_library_does():
    rng = random.Random(8)
    parts = ["a", "Été", "ß", " ", "\n", "\n\n", "\t", "'s", "12", "<|endoftext|>", "word.", "The", "漢字", "\u0085",
             ",", "×", " ", "\x1c", "é1", ":", "\r", "don't", " ."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(5000)] + [None, "x" * 300]
    own, lib = token_files.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    ids, counts = own.encode_rows(pa.array(texts), 2)
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


def test_long_texts_go_stretch_by_stretch(monkeypatch):
    monkeypatch.setattr(token_files, "LONG", 40)
    own, lib = token_files.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    for t in ["one two  three\n\nfour " * 30, "x" * 500, " a" * 200 + " "]:
        ids, _ = own.encode_rows(pa.array([t, "b"]), 2)
        assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2, 65, 2]
