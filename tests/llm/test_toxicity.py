import random
import zlib

import pytest

from pyspark.sql import functions as F

from tessella.llm import toxicity


def text(r, bad):
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "at", "en"]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 120))]
    if bad:
        for _ in range(max(2, len(words) // 20)):
            words.insert(r.randrange(len(words)), r.choice(["vulgarus", "nastibad", "Horridox.", "grumblefink"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    return [(i, text(r, i % 4 == 0), int(i % 4 == 0)) for i in range(900)]


def test_held_out_accuracy(spark, make_docs, corpus):
    docs = make_docs([(i, t, "s") for i, t, _ in corpus] + [(5000, None, "s"), (5001, "", "s"), (5002, " " * 9, "s"), (5003, "vulgarus " * 20_000, "s")]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert len(got) == len(corpus) + 4
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    judged = [(got[i].score >= 0.5) == bool(y) for i, _, y in corpus if got[i].held_out]
    assert len(judged) > 100 and sum(judged) / len(judged) > 0.97
    assert got[5000].score == got[5001].score == got[5002].score < 0.5 < got[5003].score
    again = toxicity.scores(make_docs([(i, t, "s") for i, t, _ in corpus], 5), labels).collect()
    assert {r.doc_id: r.score for r in again} == {i: got[i].score for i, *_ in corpus}


def test_held_out_labels_do_not_matter(spark, make_docs, corpus):
    docs = make_docs([(i, t, "s") for i, t, _ in corpus[:300]])
    rows = [(i, 1, y) for i, _, y in corpus[:300]]
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in rows]
    make = lambda x: {r.doc_id: r.score for r in toxicity.scores(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
    assert make(rows) == make(flipped)


def test_no_labels_and_empty(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a b", "s"), (1, "a b", "s")])
    assert [r.score for r in toxicity.scores(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.scores(make_docs([]), none).count() == 0
    one = spark.createDataFrame([(i, 0, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert toxicity.scores(make_docs([(i, "a b", "s") for i in range(9)]), one).where("score = 1").count() == 9


def test_accepted(spark, make_docs, corpus):
    docs = make_docs([(i, t, "s") for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id long, quality int, toxic int")
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = {i for i, _, y in corpus if not y}
    assert len(ids & clean) > 0.98 * len(clean) and len(ids - clean) < 0.03 * len(clean)


def test_evidence():
    assert toxicity.evidence(50, 0, 100, 1000) > 40 > toxicity.evidence(3, 0, 100, 1000)
    assert toxicity.evidence(5, 50, 100, 1000) == 0


def plain_score(model, text):
    """A document's score, step by step."""
    import math

    import zstandard

    words = text.encode().lower().split() if text else []
    parts = [b" " + b" ".join(words[i : i + 12]) + b" " for i in range(0, len(words), 12)]

    def size(content, window):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    saved = [size(model["ordinary"], w) - size(model["toxic"] + model["ordinary"], w) for w in parts]
    n = len(saved)
    if n:
        top = sorted(saved)[-3:]
        x = [sum(saved) / n, max(saved), sum(top) / len(top), *[sum(s >= k for s in saved) / n for k in (1, 2, 3, 4, 5, 6)], sum(s < 0 for s in saved) / n, math.log(1 + n), math.log(1 + sum(s >= 3 for s in saved))]
    else:
        x = [0] * 12
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model["weights"], [*x, 1]))))


def test_scores_against_a_plain_model(spark, make_docs, corpus):
    some = corpus[:240]
    docs = make_docs([(i, t, "s") for i, t, _ in some] + [(7000, None, "s"), (7001, "one", "s")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in some], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.sample(docs, labels, "doc_id", "text", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    for i, t in [*[(i, t) for i, t, _ in some[::4]], (7000, None), (7001, "one")]:
        assert abs(got[i] - plain_score(model, t)) < 1e-9


def test_the_calibration_is_at_its_optimum():
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4)) * [1, 10, 0.1, 3] + 2
    y = (r.random(300) < 1 / (1 + np.exp(-x[:, 0] + 0.1 * x[:, 1]))).astype(int)
    w = np.array(toxicity.logistic(x, y, weight=3.0))

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return (np.where(y, 3.0, 1.0) * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ((w[:-1] * (x.std(axis=0) + 1e-9)) ** 2).sum()

    for k in range(5):
        for step in (-1e-3, 1e-3):
            other = w.copy()
            other[k] += step
            assert loss(other) > loss(w)


def test_repeated_ids_and_labels(spark, make_docs):
    rows = [(i, f"fine words {i} " * 9, "s") for i in range(40)] + [(100 + i, "vile nasty " * 9, "s") for i in range(40)]
    docs = make_docs(rows + rows + [(100, "another text", "s"), (None, "vile nasty", "s")])
    labels = [(i, 1, int(i >= 100)) for i, *_ in rows]
    once = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([*labels, (101, 1, 0), (None, 1, 1), (3, 0, None)] * 2, "doc_id long, quality int, toxic int").repartition(5)
    assert sorted(toxicity.sample(docs, once, "doc_id", "text", "toxic")) == sorted(toxicity.sample(docs, more, "doc_id", "text", "toxic"))
    assert [r.held_out for r in toxicity.scores(docs, once).where("doc_id is null").collect()] == [False]
