import itertools
import random

import numpy as np

import corpus_pipeline
from tessella.llm import shingles


def jaccard(a, b):
    def own(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    a, b = own(a), own(b)
    return len(a & b) / len(a | b)


def planted(pairs, seed=3):
    """Texts and copies with a few words changed, of similarity 0.6 to 1."""
    r = random.Random(seed)
    rows = []
    for k in range(pairs):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        copy = list(words)
        for _ in range(1 + r.randrange(max(1, len(words) // 40))):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(copy), "s")]
    return rows


def test_stage_finds_planted_copies(spark, make_docs):
    rows = planted(300)
    like = [jaccard(a[1], b[1]) for a, b in itertools.batched(rows, 2)]
    assert sum(0.8 <= j < 0.95 for j in like) > 100 and min(like) < 0.8
    got = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, make_docs(rows), None).collect()}
    assert got == {2 * k for k in range(300)} | {2 * k + 1 for k, j in enumerate(like) if j < 0.8}


def test_recall_of_the_bands():
    r = np.random.default_rng(4)
    missed = 0
    for _ in range(4000):
        both, one, other = (r.integers(0, 2**64, n, np.uint64) for n in (200, 25, 25))  # similarity 0.8
        missed += not (shingles.band_keys(np.append(both, one)) == shingles.band_keys(np.append(both, other))).any()
    assert missed <= 3


def test_chunks_and_edges(make_docs, monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK", 3)
    r = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[: (p := r.randrange(200))] + [f"x{k}"] + base[p + 1 :]), "s") for k in range(30)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "One two", None), (103, "one  TWO", None), (104, "one two three", "s")]
    assert sorted(x.doc_id for x in shingles.keep_first(make_docs(rows)).collect()) == [0, 100, 102, 104]
    assert shingles.keep_first(make_docs([])).count() == 0
