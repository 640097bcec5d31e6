"""Property graphs: nodes (id, labels, properties) and edges (id, src, dst, type, labels, properties, __seq).

Traversal joins a frontier with the edges, level by level; only the frontier
and what is visited grow, both as DataFrames in stored tables.
"""

from __future__ import annotations

import threading
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import AlreadyExists, InvalidArgument, NotFound
from tessella.plans.compiler import SEQ
from tessella.sources.scratch import numbered, stored

NODE = "id long, labels array<string>, properties map<string,string>"
EDGE = f"id long, src long, dst long, type string, labels array<string>, properties map<string,string>, {SEQ} long"


#: Changes after which a graph's lineage is cut.
CUT_EVERY = 20
#: Nodes that a depth-first task gives at once.
OUT = 1 << 16


def edges_out(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node).orderBy(SEQ).select("id")


def edges_in(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("dst") == node).orderBy(SEQ).select("id")


def neighbors_out(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node).orderBy(SEQ).select(F.col("dst").alias("node_id"))


def neighbors_in(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("dst") == node).orderBy(SEQ).select(F.col("src").alias("node_id"))


def match(edges: DataFrame, node: int, kind: str | None = None) -> DataFrame:
    out = edges.where(F.col("src") == node)
    out = out if kind is None else out.where(F.upper("type") == kind.upper())
    return out.orderBy(SEQ).select(F.col("dst").alias("node_id"))


def breadth_first(edges: DataFrame, start: int, limit: int = 0, goal: int | None = None) -> DataFrame:
    """(id, parent, rank, level) of the nodes reached, in the order of a queue:
    a level's nodes by their first parent's rank, then by that edge's order.
    ``limit`` 0 is none; with ``goal`` it stops at the level that has it."""
    spark = edges.sparkSession
    links = edges.select("src", "dst", SEQ)
    seen = spark.createDataFrame([(start, None, 0, 0)], "id long, parent long, rank long, level int")
    frontier, count, level = seen, 1, 0
    while True:
        if limit and count >= limit or goal is not None and frontier.where(F.col("id") == goal).head(1):
            break
        level += 1
        found = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.col("id").alias("parent"), F.col("rank").alias("by_rank"), F.col(SEQ).alias("by_seq"))
        first = found.groupBy("id").agg(F.min(F.struct("by_rank", "by_seq", "parent")).alias("f")).select("id", "f.*")
        ranked, added = numbered(first.join(seen.select("id"), "id", "left_anti"), ["by_rank", "by_seq"], "rank", count)
        if not added:
            break
        frontier = ranked.withColumn("level", F.lit(level)).select("id", "parent", "rank", "level")
        count += added
        seen = seen.unionByName(frontier)
    return seen.where(F.col("rank") < limit) if limit else seen


def connected(edges: DataFrame, a: int, b: int) -> DataFrame:
    found = a == b or bool(breadth_first(edges, a, goal=b).where(F.col("id") == b).head(1))
    return edges.sparkSession.createDataFrame([(found,)], "value boolean")


def shortest_path(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(step, node_id) of the path that a queue finds first; no rows if there is none."""
    spark, schema = edges.sparkSession, "step long, node_id long"
    if a == b:
        return spark.createDataFrame([(0, a)], schema)
    tree = breadth_first(edges, a, goal=b)
    path = [b]
    while path[-1] != a:  # one lookup for each step of the path
        got = tree.where(F.col("id") == path[-1]).select("parent").head(1)
        if not got or got[0].parent is None:
            return spark.createDataFrame([], schema)
        path.append(got[0].parent)
    return spark.createDataFrame([*enumerate(reversed(path))], schema)


def preorder(batches, nodes: int, limit: int = 0):
    """Arrays of the nodes in preorder, first neighbour first, from node 0.

    ``batches`` are arrays of sources and of targets, by source and then in the
    order of the edges; nodes are numbers below ``nodes``, which is below 2^31.
    Four bytes are held for each edge and about forty for each node.
    """
    import numpy as np

    ahead, counts = array("i"), np.zeros(nodes + 1, "int64")
    for src, dst in batches:
        ahead.frombytes(dst.astype("int32").tobytes())
        if len(src):
            own = np.bincount(src - src[0])  # of this batch's sources alone, as they are sorted
            counts[src[0] + 1 : src[0] + 1 + len(own)] += own
    ends = array("q", counts.cumsum().tobytes())
    del counts
    at, path, seen = array("q", ends), array("i", [0]), bytearray(nodes)
    seen[0] = 1
    out, given = array("i", [0]), 1
    while path and not (limit and given >= limit):
        node = path[-1]
        here, end = at[node], ends[node + 1]
        while here < end and seen[ahead[here]]:
            here += 1
        if here == end:
            path.pop()
            continue
        at[node], node = here + 1, ahead[here]
        seen[node] = 1
        path.append(node)
        out.append(node)
        given += 1
        if len(out) == OUT:
            yield np.frombuffer(out.tobytes(), "int32")
            out = array("i")
    yield np.frombuffer(out.tobytes(), "int32")


def depth_first(edges: DataFrame, start: int, limit: int = 0) -> DataFrame:
    """(node_id, rank) in preorder, first neighbour first.

    The order is sequential by nature: the reachable edges alone, the first of
    each pair of nodes, are brought to one task, which Spark sorts on disk and
    which keeps them as numbers of four bytes.
    """
    import pyarrow as pa

    spark = edges.sparkSession
    reached = stored(breadth_first(edges, start).select("id", F.col("rank").alias("number")))
    count = reached.count()
    ends = [reached.select(F.col("id").alias(c), F.col("number").alias(n)) for c, n in (("src", "_a"), ("dst", "_b"))]
    pairs = edges.select("src", "dst", SEQ).groupBy("src", "dst").agg(F.min(SEQ).alias("_first")).join(ends[0], "src").join(ends[1], "dst")
    links = pairs.where("_a <> _b").select("_a", "_b", "_first").repartition(1).sortWithinPartitions("_a", "_first").select(F.col("_a").cast("int"), F.col("_b").cast("int"))

    def run(batches):
        rank = 0
        for nodes in preorder(((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), count, limit):
            yield pa.RecordBatch.from_arrays([pa.array(nodes.astype("int64")), pa.array(range(rank, rank + len(nodes)), pa.int64())], ["number", "rank"])
            rank += len(nodes)

    if count == 1:
        return spark.createDataFrame([(start, 0)], "node_id long, rank long")
    return links.mapInArrow(run, "number long, rank long").join(reached, "number").select(F.col("id").alias("node_id"), "rank").orderBy("rank")


def erase_node(nodes: DataFrame, edges: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lack an end."""
    ids = nodes.select("id")
    no_src = edges.join(ids, edges.src == ids.id, "left_anti")
    no_dst = edges.join(ids, edges.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_anti")
    return no_src.unionByName(no_dst)


class Graphs:
    def __init__(self, spark: SparkSession):
        self.spark, self.graphs, self.lock, self.changes = spark, {}, threading.RLock(), 0

    def create(self, name: str) -> None:
        with self.lock:
            if name in self.graphs:
                raise AlreadyExists(f"graph {name} exists")
            self.graphs[name] = (self.spark.createDataFrame([], NODE), self.spark.createDataFrame([], EDGE))

    def register(self, name: str, nodes: DataFrame, edges: DataFrame) -> None:
        with self.lock:
            if name in self.graphs:
                raise AlreadyExists(f"graph {name} exists")
            self.graphs[name] = (nodes, edges)

    def drop(self, name: str) -> None:
        with self.lock:
            self.get(name)
            del self.graphs[name]

    def names(self) -> list[str]:
        return sorted(self.graphs)

    def get(self, name: str):
        if name not in self.graphs:
            raise NotFound(f"no graph {name}")
        return self.graphs[name]

    def node(self, name: str, node: int):
        got = self.get(name)[0].where(F.col("id") == node).head(1)
        if not got:
            raise NotFound(f"no node {node}")
        return got[0]

    def edge(self, name: str, edge: int):
        got = self.get(name)[1].where(F.col("id") == edge).head(1)
        if not got:
            raise NotFound(f"no edge {edge}")
        return got[0]

    def _known(self, name: str, node: int) -> DataFrame:
        self.node(name, node)
        return self.get(name)[1]

    def edges_out(self, name: str, node: int) -> DataFrame:
        return edges_out(self._known(name, node), node)

    def edges_in(self, name: str, node: int) -> DataFrame:
        return edges_in(self._known(name, node), node)

    def neighbors_out(self, name: str, node: int) -> DataFrame:
        return neighbors_out(self._known(name, node), node)

    def neighbors_in(self, name: str, node: int) -> DataFrame:
        return neighbors_in(self._known(name, node), node)

    def _put(self, name: str, nodes: DataFrame, edges: DataFrame) -> None:
        """The graph after a change; its lineage is cut now and then."""
        self.changes = self.changes + 1
        if self.changes % CUT_EVERY == 0:
            nodes, edges = stored(nodes), stored(edges)
        self.graphs[name] = (nodes, edges)

    def put_node(self, name: str, node: int, labels=(), properties=None) -> None:
        with self.lock:
            nodes, edges = self.get(name)
            new = self.spark.createDataFrame([(node, sorted(set(labels)), dict(properties or {}))], NODE)
            self._put(name, nodes.where(F.col("id") != node).unionByName(new), edges)

    def put_edge(self, name: str, edge: int, src: int, dst: int, kind: str = "", labels=(), properties=None) -> None:
        with self.lock:
            nodes, edges = self.get(name)
            if nodes.where(F.col("id").isin(src, dst)).count() < len({src, dst}):
                raise InvalidArgument("an end of the edge is no node")
            seq = edges.agg(F.coalesce(F.max(SEQ), F.lit(-1)).alias("m")).first().m + 1
            new = self.spark.createDataFrame([(edge, src, dst, kind, sorted(set(labels)), dict(properties or {}), seq)], EDGE)
            self._put(name, nodes, edges.where(F.col("id") != edge).unionByName(new))

    def erase_node(self, name: str, node: int) -> None:
        with self.lock:
            self.node(name, node)
            self._put(name, *erase_node(*self.get(name), node))

    def erase_edge(self, name: str, edge: int) -> None:
        with self.lock:
            self.edge(name, edge)
            nodes, edges = self.get(name)
            self._put(name, nodes, edges.where(F.col("id") != edge))
