"""The graph language: TRAVERSE, MATCH, SHORTEST_PATH and CONNECTED."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument
from tessella.operators import graph as G

EDGE_TYPE = re.compile(r"\[\s*\w*\s*:\s*(\w+)\s*\]")


def _whole(token: str) -> int:
    """The whole number at the start of a token."""
    found = re.match(r"[+-]?\d+", token)
    if not found:
        raise InvalidArgument(f"{token!r} is no id")
    return int(found[0])


def _words(tokens, *want):
    if len(tokens) < len(want) or any(w is not None and t.upper() != w for t, w in zip(tokens, want)):
        raise InvalidArgument("expected " + " ".join(w or "<value>" for w in want))


def traverse(graphs: G.Graphs, tokens) -> DataFrame:
    _words(tokens, "TRAVERSE", None, "FROM", None, None)
    _, edges = graphs.get(tokens[1])
    start, how = _whole(tokens[3]), tokens[4].upper().rstrip(";")
    limit = 0
    if len(tokens) >= 7 and tokens[5].upper() == "LIMIT":
        limit = _whole(tokens[6])
        if limit < 0:
            raise InvalidArgument("LIMIT is negative")
    graphs.node(tokens[1], start)
    if how == "BFS":
        return G.breadth_first(edges, start, limit).orderBy("rank").select(F.col("id").alias("node_id"))
    if how == "DFS":
        return G.depth_first(edges, start, limit).orderBy("rank").select("node_id")
    raise InvalidArgument(f"no traversal {how}")


def shortest_path(graphs: G.Graphs, tokens) -> DataFrame:
    _words(tokens, "SHORTEST_PATH", None, "FROM", None, "TO", None)
    a, b = _whole(tokens[3]), _whole(tokens[5])
    if a == b:  # holds without a look at the graph
        return graphs.spark.createDataFrame([(0, a)], "step long, node_id long")
    _, edges = graphs.get(tokens[1])
    graphs.node(tokens[1], a)
    return G.shortest_path(edges, a, b)


def connected(graphs: G.Graphs, tokens) -> DataFrame:
    _words(tokens, "CONNECTED", None, "FROM", None, "TO", None)
    a, b = _whole(tokens[3]), _whole(tokens[5])
    if a == b:
        return graphs.spark.createDataFrame([(True,)], "value boolean")
    _, edges = graphs.get(tokens[1])
    graphs.node(tokens[1], a)
    return G.connected(edges, a, b)


def match(graphs: G.Graphs, text: str, tokens) -> DataFrame:
    """One hop outwards from a; direction and labels of the pattern are not read."""
    _words(tokens, "MATCH", None)
    _, edges = graphs.get(tokens[1])
    found = re.search(r"\bWHERE\s+a\s*=\s*(\S+)\s+RETURN\s+(\w+)", text, re.I)
    if not found or found[2].lower() != "b":
        raise InvalidArgument("MATCH needs WHERE a = <id> RETURN b")
    kind = EDGE_TYPE.search(text[: found.start()])
    node = _whole(found[1])
    graphs.node(tokens[1], node)
    return G.match(edges, node, kind[1] if kind else None)


def execute(graphs: G.Graphs, text: str) -> DataFrame:
    tokens = text.split()
    verb = tokens[0].upper() if tokens else ""
    if verb == "TRAVERSE":
        return traverse(graphs, tokens)
    if verb == "MATCH":
        return match(graphs, text, tokens)
    if verb == "SHORTEST_PATH":
        return shortest_path(graphs, tokens)
    if verb == "CONNECTED":
        return connected(graphs, tokens)
    raise InvalidArgument(f"no graph statement {verb}")
