"""The near-duplicate stage proposes by SimHash, and by nothing beside it."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import shingles, simhash
from tests.llm.test_shingles import planted
from tests.llm.test_simhash import model_components


def test_pairs_come_from_fingerprints(make_docs, monkeypatch):
    """Where no two fingerprints are near, only texts with the same shingles are joined."""
    rows = [*planted(20), (100, None, "s"), (101, " ", "s"), (102, "One two", "s"), (103, "one  TWO", "s")]
    assert len(corpus_pipeline.simhash_stage(None, make_docs(rows), None).collect()) < 40
    monkeypatch.setattr(shingles, "distance_for", lambda similarity: -1)
    got = {r.doc_id for r in corpus_pipeline.simhash_stage(None, make_docs(rows), None).collect()}
    assert got == {i for i, *_ in rows} - {101, 103}


def mixed(h, k):
    z, m = h + k * 0x9E3779B97F4A7C15, 2**64 - 1
    z = ((z & m) ^ (z & m) >> 30) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ z >> 27) * 0x94D049BB133111EB & m
    return z ^ z >> 31


@pytest.mark.parametrize("n", [1, 2, 30, 255, 256, 1000])
def test_fingerprint_against_model(n):
    r = random.Random(n)
    text = " ".join(f"w{r.randrange(10**9)}" for _ in range(n + 4))
    own = shingles.shingles(text)
    want = []
    for k in range(3):
        z = [mixed(h, k) if k else h for h in own.tolist()]
        want += [int(2 * sum(x >> 63 - b & 1 for x in z) > n) for b in range(64)]
    assert len(own) == n and simhash.majority(own, 3).tolist() == want
    assert np.packbits(want[:64]).tobytes() == simhash.fingerprint(text, shingles.WORDS)


@pytest.mark.parametrize("n", [10**3, 10**5, 10**8])
def test_recall_of_tables_and_first_bits(n):
    """Pairs of a similarity of 0.8 share a key and have near first bits, whatever the number of texts."""
    r, (bits, tables), missed, far = np.random.default_rng(4), shingles.tables_for(n), 0, 0
    for _ in range(1000):
        size = int(r.integers(1, 40))  # shared shingles: 8 times that of 10
        both, one, other = (r.integers(0, 2**64, m, np.uint64) for m in (8 * size, size, size))
        x, y = (shingles.fingerprint(np.append(both, z), bits, tables) for z in (one, other))
        missed += not (shingles.table_keys(x, bits, tables) == shingles.table_keys(y, bits, tables)).any()
        far += (x != y)[: shingles.NEAR_BITS].sum() > shingles.distance_for()
    assert missed <= 1 and far <= 1


@pytest.mark.parametrize("dense", [0, 150])
def test_joined(dense):
    r = np.random.default_rng(9)
    near, label = r.integers(0, 2**64, (200, 3), np.uint64), np.arange(200)
    label[180:] = label[:20]
    near[40:120] = near[r.integers(0, 40, 80)]
    near[:dense] = near[0]
    near[:, 1] ^= np.uint64(1) << r.integers(0, 20, 200, dtype=np.uint64)
    want = model_components({i: int(a) << 128 | int(b) << 64 | int(c) for i, (a, b, c) in enumerate(near)}, 2)
    for i in range(180, 200):
        want = {k: min(want[i], want[i - 180]) if v in (want[i], want[i - 180]) else v for k, v in want.items()}
    assert shingles.joined(near, label, 2).tolist() == [want[i] for i in range(200)]


def test_buckets_with_very_many_fingerprints(make_docs, monkeypatch):
    rows = planted(60)
    want = {r.doc_id for r in shingles.keep_first(make_docs(rows)).collect()}
    monkeypatch.setattr(shingles, "BUCKET", 6)
    monkeypatch.setattr(shingles, "CHUNK", 2)
    assert {r.doc_id for r in shingles.keep_first(make_docs(rows)).collect()} == want and len(want) < 120
