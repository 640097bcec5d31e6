"""Depth-first order against a plain model, and what its task holds."""

import random
import tracemalloc

import numpy as np

from tessella.operators import graph as G
from tessella.plans.compiler import SEQ


def model(links, start, limit=0):
    out, stack = [], [start]
    while stack and not (limit and len(out) >= limit):
        a = stack.pop()
        if a not in out:
            out.append(a)
            stack.extend(b for x, b in reversed(links) if x == a)
    return out


def test_many_edges_between_the_same_nodes(spark):
    r = random.Random(11)
    ids = [r.randrange(1 << 40) for _ in range(60)]
    links = [(r.choice(ids), r.choice(ids)) for _ in range(150)]
    links = links + r.sample(links, 100) + [(ids[0], ids[0])]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(links)], f"src long, dst long, {SEQ} long").repartition(5)
    start = links[0][0]
    for limit in (0, 1, 7):
        got = [tuple(x) for x in G.depth_first(edges, start, limit).collect()]
        assert got == [(n, i) for i, n in enumerate(model(links, start, limit))]


def test_a_task_holds_few_bytes_an_edge():
    r, nodes, edges = np.random.default_rng(5), 2000, 1_000_000
    src, dst = np.sort(r.integers(0, nodes, edges)), r.integers(0, nodes, edges)
    batches = ((src[i : i + 10_000], dst[i : i + 10_000]) for i in range(0, edges, 10_000))
    tracemalloc.start()
    got = np.concatenate([*G.preorder(batches, nodes)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got.tolist()) == [*range(nodes)]
    assert peak < 10 * edges
