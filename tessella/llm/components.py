"""Connected components by alternating star operations, all distributed.

Each round replaces a vertex's links by links to its smallest neighbour, first
for larger neighbours, then for smaller ones, until only stars are left; the
number of rounds grows with the logarithm of the longest chain.  A vertex with
very many links is a hot join key: both sides of each join are read from
stored tables, so that adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, stored


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _star(links: DataFrame, least: DataFrame, keep) -> DataFrame:
    """(v, least neighbour of u) for each link (u, v)."""
    return links.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest vertex reachable, for every vertex with a link."""
    links = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least", 2 * state[0])
        large = stored(_star(both, least, F.col("v") > F.col("u")).distinct(), "links", 2 * state[0])
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least_down = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least", 2 * state[0])
        small = _star(down, least_down, F.lit(True)).unionByName(least_down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", 2 * state[0])
        now = _state(small)
        for old in (links, least, large, least_down):
            discard(old)
        links = small
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
