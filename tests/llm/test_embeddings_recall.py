import numpy as np
import pytest

from tessella.llm import embeddings


@pytest.mark.parametrize("k, d, pairs", [(2, 64, 3000), (3, 64, 3000), (4, 64, 3000), (2, 384, 1000), (3, 384, 1000)])
def test_recall_at_the_threshold(k, d, pairs):
    """Pairs with a cosine of 0.93 meet in a table, whatever the hashes of a key and the dimensions."""
    r = np.random.default_rng(7)
    x, side = r.normal(size=(2, pairs, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side
    tables = max(embeddings.TABLES, embeddings.tables_for(k, 1 << (d - 1).bit_length()))
    home, probes = embeddings.signatures(np.concatenate([x, y]), tables, k)
    i, j = np.arange(pairs), np.arange(pairs, 2 * pairs)
    met, before = np.zeros(pairs, bool), 0
    for t in range(tables):
        met |= embeddings.meets(i, j, home, probes, t)[0]
        before = met.sum() if t == embeddings.TABLES - 1 else before
    print(f"k {k}, {d} dimensions: {tables} tables, {pairs - met.sum()} of {pairs} missed, {pairs - before} in the first ten")
    assert met.mean() >= 0.999
