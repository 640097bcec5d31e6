import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessella.llm import suffix


def model(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            w = data[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8))) for _ in range(n))


def corpus():
    r = random.Random(11)
    passage, line = words(r, 40), "the common line of seventy or so bytes that stands in many documents ok"
    rows = {0: None, 1: "", 2: "short", 3: "ab" * 700, 4: "z" * 5000, 5: "z" * 300, 6: words(r, 400)}
    for k in range(7, 90):
        kind, t = k % 6, words(r, 60)
        if kind == 0:
            t = t[:100] + passage + t[100:]
        elif kind == 1:
            t = rows[6][r.randrange(800) :][:500] + t
        elif kind == 2:
            w = rows[6].split()
            w[r.randrange(len(w))] = f"x{k}"
            t = " ".join(w)
        elif kind == 3:
            t = t + "\n" + line + "\n" + words(r, 20) + t
        elif kind == 4:
            t = rows[k - 4] or ""
        rows[k] = t
    for k in range(90, 260):
        rows[k] = words(r, 12) + "\n" + line + "\n" + (line[5:] if k % 3 else "") + words(r, 12)
    for k in range(260, 300):  # stretches with a period, short and long, and their borders
        unit = words(r, r.randrange(1, 12)) + " "
        rows[k] = words(r, r.randrange(0, 30)) + unit * r.randrange(2, 30) + words(r, r.randrange(0, 30)) + unit * r.randrange(0, 9)
    return rows


def result(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(suffix.repeated(docs)).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(make_docs, monkeypatch, small):
    if small:  # many flushes, splits by window and cuts of the suffix arrays
        monkeypatch.setattr(suffix, "FLUSH_BYTES", 3000)
        monkeypatch.setattr(suffix, "CONTENTS", 3)
        monkeypatch.setattr(suffix, "FLUSH_CONTENTS", 2)
        monkeypatch.setattr(suffix, "SUFFIX_BYTES", 3000)
        monkeypatch.setattr(suffix, "SEGMENT", 512)
    rows = corpus()
    docs = make_docs([(i, t, "s") for i, t in rows.items()]).withColumn("bucket", F.lit("clash")).withColumn("kept", F.lit(0))
    got, want = result(docs), model(rows)
    assert got.keys() == want.keys()
    assert not [(i, got[i], want[i]) for i in want if got[i] != want[i]]


def test_edges(make_docs):
    assert result(make_docs([])) == {}
    same = make_docs([(1, "q" * 150, "s")] * 2 + [(2, "q" * 150, "s")])
    assert [r.n_removed for r in suffix.digests(suffix.repeated(same)).orderBy("doc_id").collect()] == [149, 149, 150]


def test_whole_characters(make_docs):
    body = "é" * 30 + words(random.Random(1), 30)
    docs = make_docs([(1, "a" + body, "s"), (2, "ü" + body + "é", "s"), (3, None, "s")])
    got = {r.doc_id: r for r in suffix.without_repeats(docs).collect()}
    assert got[1].text == "a" + body and got[3].text is None
    assert got[2].text == "üé" and got[2].n_chars == 2 and got[2].source == "s"


def model_lpf(data, starts, length):
    return [max([next((k for k in range(length) if data[a + k] != data[b + k]), length) for b in starts[:i]] or [0]) for i, a in enumerate(starts)]


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=20, max_size=120), st.integers(0, 3))
def test_longest_previous_factors(text, seed):
    data = np.frombuffer((text + text[: seed * 7]).encode(), np.uint8)
    for length in (12, 7, 15):
        starts = np.arange(len(data) - length)
        assert model_lpf(data, starts.tolist(), length) == suffix.longest_previous_factors(data, starts, starts, length).tolist()


@pytest.mark.parametrize("length", [10, 50, 99])
def test_all_lengths(make_docs, length):
    rows = {i: t for i, t in corpus().items() if i < 120 or i >= 280}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(suffix.repeated(make_docs([(i, t, "s") for i, t in rows.items()]), length=length)).collect()}
    assert got == model(rows, length)


def test_repeated_ids_with_other_texts(make_docs):
    """Each text of an id is a document of its own; the same text again is the same document."""
    passage = words(random.Random(3), 40)
    rows = [(1, passage, "s"), (1, passage + "x", "s"), (1, passage, "s"), (2, "y" + passage, "s"), (None, passage, "s")]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.digests(suffix.repeated(make_docs(rows))).collect()]
    n = len(passage.encode())
    under_1 = sorted(g for g in got if g[0] == 1)
    assert under_1 in ([(1, n, 0), (1, n, 0), (1, n + 1, n)], [(1, n, n), (1, n, n), (1, n + 1, 0)])
    assert [g for g in got if g[0] != 1 and g[0]] == [(2, n + 1, n)] and (None, n, 0) in got


def test_equal_hashes_do_not_remove(make_docs, monkeypatch):
    """Bytes decide: with all content hashes equal the result is the same."""
    whole = suffix.pieces_of
    monkeypatch.setattr(suffix, "pieces_of", lambda *a, **k: (lambda v, c, *rest: (v, c * 0, *rest))(*whole(*a, **k)))
    rows = {i: t for i, t in corpus().items() if i < 110}
    assert result(make_docs([(i, t, "s") for i, t in rows.items()])) == model(rows)


def test_clashing_columns(make_docs):
    body = words(random.Random(1), 40)
    docs = make_docs([(1, body, "s"), (2, body, "s")])
    for c in ("_id", "_kept", "_null", "_row", "key", "bucket"):
        docs = docs.withColumn(c, F.lit(c))
    got = suffix.without_repeats(docs).orderBy("doc_id").collect()
    assert [r.text for r in got] == [body, ""] and all(r[c] == c for r in got for c in ("_id", "_kept", "_null", "_row", "key", "bucket"))


def test_buckets_are_those_of_the_plan(spark):
    ids = [0, 1, -1, 7, 10**12, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(37)).alias("b"))
    assert {r.i: r.b for r in df.collect()} == dict(zip(ids, suffix.bucket_of(np.array(ids), 37).tolist()))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text("abc ", min_size=100, max_size=700), st.builds(lambda a, u, n, b: a + u * n + b, st.text("abc ", max_size=60), st.text("abc ", min_size=30, max_size=140), st.integers(4, 9), st.text("abc ", max_size=60))))
def test_pieces_cover_all_windows(text):
    data = np.frombuffer(text.encode(), np.uint8)
    rolling = suffix.Rolling()
    anchor, content, start, n, inner = suffix.pieces_of(rolling, data)
    assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and start[-1] + n[-1] == len(data) - 99
    by = {}
    for a, s, k in zip(anchor, start, n):
        for x in range(s, s + k):
            assert by.setdefault(text[x : x + 100], a) == a
    for s, k, repeats in zip(start, n, inner):
        own = [text[x : x + 100] for x in range(s, s + k)]
        assert repeats or len(set(own)) == len(own)
