"""Groups that are cut or dealt anew, and ids that are null or repeated."""

import itertools

import numpy as np
import pytest

from tessella.llm import embeddings, simhash
from tests.llm.test_embeddings import brute, result
from tests.llm.test_simhash import model_components


def close_fingerprints(n, bits=22, seed=4):
    r = np.random.default_rng(seed)
    flips = (np.uint64(1) << r.integers(0, bits, (n, 5), dtype=np.uint64)).cumsum(axis=1, dtype=np.uint64)[:, -1]
    return np.unique(np.uint64(0x123456789ABCDEF0) ^ flips).view(np.int64).tolist()


def test_blocks_with_very_many_fingerprints(spark, monkeypatch):
    fps = close_fingerprints(700) + close_fingerprints(60, 60, 5)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # groups span batches
    try:
        got = simhash.components(simhash.links(df, len(fps)), "a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = {f: f for f in fps} | {r.node: r.root for r in got}
    want = model_components({f & (2**64 - 1): f & (2**64 - 1) for f in fps})
    groups = lambda pairs: sorted(sorted(x for x, _ in g) for _, g in itertools.groupby(sorted(pairs, key=lambda p: p[1]), key=lambda p: p[1]))
    assert groups((f & (2**64 - 1), c) for f, c in root.items()) == groups(want.items())


def test_bounded_groups():
    import pyarrow as pa

    keys = [1] * 3 + [2] * 25 + [3] * 2 + [4] * 9 + [5]
    batches = [pa.record_batch([pa.array(keys[i : i + 4])], ["k"]) for i in range(0, len(keys), 4)]
    got = [(t.column(0).to_pylist(), hot) for t, hot in simhash.bounded_groups(batches, 1, 10)]
    assert sum((x for x, _ in got), []) == keys
    assert all(set(x) == {2} for x, hot in got if hot) and not any(2 in x for x, hot in got if not hot)
    assert all(sum(k in x for x, _ in got) == 1 for k in (1, 3, 4, 5))


def test_null_and_repeated_vector_ids(spark):
    r = np.random.default_rng(1)
    base = [np.float32(v).tolist() for v in r.normal(size=(6, 64))]
    near = lambda v: np.float32(np.array(v) * 1.5 + 0.01).tolist()
    rows = [(None, base[0], 1), (3, near(base[0]), 1), (1, base[1], 1), (1, base[2], 1), (2, base[3], 1), (None, base[4], 1), (None, near(base[4]), 1), (None, base[5], 2), (9, base[5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(((x.vec_id or 0, x.n_links, x.component_id or 0, x.kept) for x in embeddings.near_duplicates(df).collect()))
    assert got == sorted([(0, 1, 3, False), (3, 1, 3, True), (1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (0, 1, 0, True), (0, 1, 0, True), (0, 1, 9, False), (9, 1, 9, True)])


def test_double_vectors_and_text_labels(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(30, 130))
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(base)] + [(100 + i, (v + 0.2 * r.normal(size=130)).tolist(), "ab"[i % 2]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_sketches_keep_pairs_at_the_threshold():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    apart = np.bitwise_count((embeddings.sketch(x) ^ embeddings.sketch(z)).view(np.uint64))
    most = embeddings.sketch_distance(0.93)
    assert 16 < most < 28 and apart.max() <= most
    assert embeddings.sketch_distance(1.0) == 0


@pytest.mark.parametrize("n, width", [(10**8, 64), (10**10, 64), (10**10, 256)])
def test_recall_of_large_inputs(n, width):
    """Planted pairs at the threshold meet in a table, however many hashes make a key."""
    r = np.random.default_rng(7)
    k = embeddings.hashes_for(n, 2 * width)
    tables = embeddings.tables_for(k, width)
    x, y = r.normal(size=(2, 1000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    home, probes = embeddings.signatures(np.concatenate([x, 0.93 * x + np.sqrt(1 - 0.93**2) * y]), tables, k)
    i, met = np.arange(1000), np.zeros(1000, bool)
    for t in range(tables):
        met |= embeddings.meets(i, i + 1000, home, probes, t)[0]
    assert met.mean() >= 0.998, (k, tables, met.mean())


def test_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 40)
    r = np.random.default_rng(6)
    base = r.normal(size=64)
    rows = [(i, np.float32(base + 0.1 * r.normal(size=64)).tolist(), 1) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = result(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)
