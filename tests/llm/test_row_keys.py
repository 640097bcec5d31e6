"""The pipeline's stages with null and repeated ids."""

import random

import pytest

import corpus_pipeline
from tessella.llm import simhash


def text(k, n=80):
    r = random.Random(k)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for _ in range(n))


ROWS = [(1, text(1), "a"), (1, text(1), "a"), (2, text(2), "a"), (2, text(3), "b"), (None, text(4), "a"), (None, text(5), "b"), (None, None, "b"), (6, text(6), None), (None, text(6), None)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")


@pytest.mark.parametrize("stage", [corpus_pipeline.simhash_stage, lambda spark, docs, _: simhash.keep_first(docs)])
def test_near_duplicates(spark, make_docs, stage):
    got = [(r.doc_id, r.text) for r in stage(spark, make_docs(ROWS), None).collect()]
    assert sorted(got, key=key) == sorted({(i, t) for i, t, _ in ROWS if (i, t) != (None, text(6))}, key=key)


def test_suffix(spark, make_docs):
    passage = text(9, 30)
    rows = [*ROWS, (10, "x " + passage, "a"), (None, text(11) + passage, "a")]
    out = corpus_pipeline.suffix_stage(spark, make_docs(rows), None).collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    got = sorted(((r.doc_id, r.text) for r in out), key=key)
    want = [(i, t) for i, t, _ in ROWS]
    want[1], want[8] = (1, ""), (None, "")  # the later copy is cut
    assert got == sorted([*want, (10, "x " + passage), (None, text(11))], key=key)


def test_mixing(spark, make_docs):
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (None, "four five six", "a"), (None, "seven", "a"), (2, "eight", "a")] * 3
    out = corpus_pipeline.mixing_stage(spark, make_docs(rows), None).collect()
    # one source: its target is its size, so that each row is taken once
    assert sorted(((r.doc_id, r.text) for r in out), key=key) == sorted([(i, t) for i, t, _ in rows], key=key)
