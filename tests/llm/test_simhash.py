import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from pyspark.sql import functions as F

from tessella.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def model_components(fps, distance=4):
    """fps: id -> fingerprint."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= distance:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_against_model(hard_rows):
    for _, t, _ in hard_rows:
        assert int.from_bytes(simhash.fingerprint(t), "big") == model_fingerprint(t), repr(t)


def corpus():
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) + str(r.randrange(90)) for _ in range(120)) for _ in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    for k in range(160):
        words = base[0 if k % 2 else r.randrange(40)].split()
        words[r.randrange(len(words))] = f"new{k}"
        rows.append((100 + k, " ".join(words), "s"))
    return rows + [(900 + k, base[1], "s") for k in range(30)] + [(2000, "", "s"), (2001, None, "s"), (2002, " \t", "s"), (2003, "One two", None), (2004, "one TWO", None)]


def test_near_duplicates_against_model(make_docs):
    rows = corpus()
    docs = make_docs(rows).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).withColumn("hex", simhash.hexadecimal("fp")).collect()}
    fps = {i: model_fingerprint(t) for i, t, _ in rows}
    assert {i: int(r.hex, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == model_components(fps)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(model_components(fps).values())


def test_empty(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_every_block_choice_finds_all_links():
    r = np.random.default_rng(1)
    for n in (10, 10**5, 10**7, 10**9, 10**11):
        masks = simhash.block_masks(n)
        for _ in range(200):
            flips = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
            assert any(flips & m == 0 for m in masks)


def test_reach_connects_what_is_connected():
    r = np.random.default_rng(2)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 24, 300, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 24, 300, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 24, 300, dtype=np.uint64)))
    a, b = simhash.reach(fps, 2)
    assert all(bin(int(x) ^ int(y)).count("1") <= 2 for x, y in zip(a, b)) and len(a) < len(fps)
    root = {int(x): int(x) for x in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a, b):
        root[find(int(y))] = find(int(x))
    want = model_components({int(x): int(x) for x in fps}, 2)
    groups = defaultdict(set)
    for x in root:
        groups[find(x)].add(x)
    expected = defaultdict(set)
    for x, c in want.items():
        expected[c].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
