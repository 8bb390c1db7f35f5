import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from kpiloom.llm import simhash
from kpiloom.llm.components import connected_components

from .data import awkward_documents, components, empty_documents


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    first = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return sorted(((i, fp, first.get(c)) for (i, _), fp, c in zip(rows, fps, label)), key=str)


def test_groups_match_brute_force(spark):
    docs = awkward_documents(spark)
    got = sorted(((r.id, r.fp % (1 << 64), r.component) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_sf_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(((r.id, r.fp % (1 << 64), r.component) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("lanes,tile", [(1, 3), (4, 5), (8, 4096)])
def test_links_of_dense_fingerprints(spark, lanes, tile):
    rng = random.Random(lanes)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for _ in range(120):
        x = centre
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.link_fingerprints(df, 2, tile=tile, lanes=lanes)
    got = {r.node % (1 << 64): r.component for r in connected_components(edges).collect()}
    want = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, []).append(f)
    for members in groups.values():
        labels = {got.get(f, f"alone {f}") for f in members}
        assert len(labels) == 1
    assert len({got.get(f, f"alone {f}") for f in fps}) == len(groups)


def test_dedup_keeps_one_row_of_each_group(spark):
    docs = awkward_documents(spark)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r in brute_groups([(r.doc_id, r.text) for r in docs.collect()]):
        groups.setdefault(r[2], []).append(r[0])
    ids = [r.doc_id for r in kept.collect()]
    want = [min(i for i in g if i is not None) for c, g in groups.items() if c is not None]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) <= len(groups.get(None, []))


def test_empty_table(spark):
    assert simhash.simhash_groups(empty_documents(spark)).count() == 0
    assert simhash.simhash_dedup(empty_documents(spark)).count() == 0


def test_long_text_in_pieces_gives_the_same_hashes():
    rng = random.Random(3)
    data = b" ".join(rng.choice([b"a", b"bb", b"Ccc"]) for _ in range(500))
    whole = np.concatenate(list(simhash.shingle_hashes(data, 3)))
    parts = np.concatenate(list(simhash.shingle_hashes(data, 3, chunk=7)))
    assert np.array_equal(whole, parts)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long")
    groups = {}
    for r in connected_components(df).collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(1, 41)), list(range(100, 160)), [200, 201]]
