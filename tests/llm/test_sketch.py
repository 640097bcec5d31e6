import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.llm import sketch


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def true_resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    r = random.Random(8)
    rows = [(i * 3, " ".join("w%d" % r.randrange(400) for _ in range(r.randrange(0, 400)))) for i in range(60)]
    return rows + [(1, None), (4, ""), (7, " \n"), (10, "one two"), (13, "One  TWO"), (16, "é" * 50), (19, "日本 " * 300), (500, rows[5][1]), (501, rows[5][1])]


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_against_brute_force(spark, make_docs, parts, monkeypatch):
    rows = corpus()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts + 2))
    try:
        got = {r.doc_id: r for r in sketch.against_edits(make_docs([(i, t, "s") for i, t in rows], parts).withColumn("fingerprint", F.lit(1))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    assert sorted(got) == sorted(text)
    make = sketch.Sketcher()
    errors = []
    for i, j in zip(order, order[1:] + order[:1]):
        m = len(text[i]) // 3
        new = text[i][: len(text[i]) - m] + text[j][:m]
        r = got[i]
        assert r.n_chars == len(text[i]) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == sketch.text_of(make(text[i])) and r.edited_fingerprint == sketch.text_of(make(new))
        errors += [r.near_edited - true_resemblance(text[i], new), r.near_next - true_resemblance(text[i], text[j])]
    assert max(map(abs, errors)) < 0.15 and np.std(errors) < 0.04
    assert got[500].fingerprint == got[501].fingerprint == got[15].fingerprint


def test_one_and_none(make_docs):
    assert sketch.against_edits(make_docs([])).count() == 0
    (r,) = sketch.against_edits(make_docs([(5, "abc def ghi", "s")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest() and r.near_next == 1.0


def test_repeated_ids(make_docs):
    got = sketch.against_edits(make_docs([(5, "abc def ghi", "s")] * 4 + [(None, "x y z", "s"), (2, "q", None)])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "5", "5", "5", "5", "None"]


def test_merge_and_estimates(make_docs):
    r = random.Random(2)
    parts = [" ".join("v%d" % r.randrange(3000) for _ in range(900)) for _ in range(12)]
    make = sketch.Sketcher()
    docs = make_docs([(i, t, "hot" if i % 4 else "cold") for i, t in enumerate(parts)])
    made = sketch.sketches(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {x.source: x for x in sketch.merged(made, "source").collect()}
    for name, rest in (("hot", 0), ("cold", 1)):
        own = [t for i, t in enumerate(parts) if (i % 4 == 0) == bool(rest)]
        assert got[name].fingerprint == sketch.text_of(sketch.merge([make(t) for t in own]))
        true = len(set.union(*map(shingles, own)))
        assert abs(got[name].n_shingles - true) < 0.3 * true
    half = parts[0] + " " + parts[1]
    assert sketch.containment(make(parts[0]), make(half)) > 0.85
    assert abs(sketch.containment(make(half), make(parts[0])) - 0.5) < 0.2


def test_merge_in_parts(make_docs):
    """Few keys held at once, a null key, and tasks without rows."""
    texts = [" ".join(f"w{(7 * i + j) % 90}" for j in range(40)) for i in range(30)]
    key = lambda i: None if i % 3 == 0 else f"s{i % 5}"
    docs = make_docs([(i, t, key(i)) for i, t in enumerate(texts)], parts=40)
    made = sketch.sketches(docs).join(docs.select("doc_id", "source"), "doc_id").repartition(40, "doc_id")
    got = {x.source: x.fingerprint for x in sketch.merged(made, "source", keys=2).collect()}
    make = sketch.Sketcher()
    want = {key(i): sketch.text_of(sketch.merge([make(t) for j, t in enumerate(texts) if key(j) == key(i)])) for i in range(30)}
    assert got == want
    assert sketch.merged(made.where("doc_id < 0"), "source").collect() == []
