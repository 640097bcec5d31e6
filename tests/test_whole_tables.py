import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tessella.plans import registry
from tests.test_models import model_retention

N = 10_400


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    return [(i, r.randrange(40), r.choice(["click", "view"]), 1_704_067_200 + i * 300 + r.randrange(600)) for i in range(N)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("whole"))
    full = [(i, datetime(2024, 1, 1) + timedelta(seconds=t - 1_704_067_200), u, k, 1.0, "{}") for i, u, k, t in rows]
    spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def in_order_of_arrival(rows):
    return sorted(((i // 10_007 * 10_007 + i * 7919 % 10_007, i, u, t) for i, u, _, t in rows))


def test_retention_of_all_rows(spark, sf, rows):
    came = in_order_of_arrival(rows)
    assert len({a for a, *_ in came}) == N
    got = {r.event_id for r in registry.retention_ttl(spark, sf).collect()}
    assert got == model_retention([(i, t) for _, i, _, t in came], 2_000_000, 0) and N - 1 in got
    got = {r.event_id for r in registry.retention_rows(spark, sf).collect()}
    assert got == {i for *_, i in sorted(((t // 3600, a, i) for a, i, _, t in came), reverse=True)[:777]}
    got = {r.event_id for r in registry.retention_both(spark, sf).collect()}
    assert got == set().union(*(model_retention([(i, t) for _, i, v, t in came if v == u], 2_000_000, 20) for u in range(40)))


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A chain of users that goes on after the first 160 events and ends in a ring."""
    path = str(tmp_path_factory.mktemp("far"))
    users = [i // 20 if i < 240 else 20 + i % 7 for i in range(300)]
    spark.createDataFrame([(i, datetime(2024, 1, 1), u, "view", 1.0, "{}") for i, u in enumerate(users)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path, [(users[i], users[i + 3]) for i in range(len(users) - 3)]


def test_graph_of_all_edges(spark, far):
    path, links = far
    queries, start = registry.queries(), links[0][0]
    levels, todo, order = {start: 0}, deque([start]), []
    while todo:
        a = todo.popleft()
        order.append(a)
        for x, b in links:
            if x == a and b not in levels:
                levels[b] = levels[a] + 1
                todo.append(b)
    preorder, stack = [], [start]
    while stack:
        a = stack.pop()
        if a not in preorder:
            preorder.append(a)
            stack.extend(b for x, b in reversed(links) if x == a)
    run = lambda name: [tuple(r) for r in queries[name](spark, path).collect()]
    assert max(levels.values()) > 8 and dict(run("graph_bfs_levels")) == levels
    assert [r[0] for r in run("graph_traverse_dfs")] == preorder
    assert [r[0] for r in run("graph_traverse_limit")] == order[:7]
    assert [r[0] for r in run("graph_match_untyped")] == [b for x, b in links if x == start]
    assert run("graph_unreachable") == []
