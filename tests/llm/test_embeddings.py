import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.llm import embeddings


def brute(rows, threshold=0.93):
    """rows: (vec_id, vector or None, label)."""
    good = []
    for i, v, y in rows:
        x = None if v is None or y is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and np.isfinite(x).all() and x.any():
            good.append((i, x, y))
    ids = [i for i, *_ in rows]
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x, y) in enumerate(good):
        for j, z, w in good[:n]:
            if y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def corpus(seed=3, near=0.03):
    r = np.random.default_rng(seed)
    f32 = lambda x: np.float32(x).tolist()
    base = r.normal(size=(120, 64))
    rows = [(i, f32(v), i % 3) for i, v in enumerate(base)]
    rows += [(200 + k, f32(base[k % 40] + near * r.normal(size=64) * np.linalg.norm(base[k % 40])), (k % 40) % 3) for k in range(100)]
    rows += [(400 + k, f32(base[7] + 0.012 * r.normal(size=64) * np.linalg.norm(base[7])), 1) for k in range(90)]  # a dense group
    rows += [(600 + k, rows[5][1], 2 if k % 4 else 0) for k in range(30)]  # copies
    rows += [(700, None, 1), (701, [0.0] * 64, 1), (702, [float("nan")] + [1.0] * 63, 1), (703, [float("inf")] + [1.0] * 63, 1), (704, rows[5][1], None), (705, [None] + [1.0] * 63, 1)]
    rows += [(706, [], 1), (707, [1.0, 2.0], 1), (708, [2.0, 4.0], 1), (709, [3.0] * 3, 1)]
    return rows


def result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash")).repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}


@pytest.mark.parametrize("chunk", [512, 16])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = corpus()
    got, want = result(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    assert not [(i, got[i], want[i]) for i in want if got[i] != want[i]]


def test_empty(spark):
    assert result(spark, []) == {}
    assert result(spark, [(1, None, 1)]) == {1: (0, 1, True)}


@pytest.mark.parametrize("n", [10**4, 10**7])
def test_recall_at_the_threshold(n):
    """Pairs with a cosine of 0.93 to 0.94 meet in a table."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(0.93, 0.94, size=(3000, 1))
    y = c * x + np.sqrt(1 - c * c) * side
    k = embeddings.hashes_for(n, 128)
    home, probes = embeddings.signatures(np.concatenate([x, y]), embeddings.TABLES, k)
    i, j = np.arange(3000), np.arange(3000, 6000)
    met = np.zeros(3000, bool)
    for t in range(embeddings.TABLES):
        met |= embeddings.meets(i, j, home, probes, t)[0]
    assert met.mean() > (0.995 if k == 2 else 0.95), met.mean()


def test_hadamard_is_the_matrix():
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(embeddings.hadamard(x), x @ h)
