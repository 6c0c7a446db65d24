"""Connected components of a graph of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Far more rounds than any graph needs: they grow with the logarithm of its longest path.
MOST_ROUNDS = 60


#: Links from which on each node's least neighbour is written before it is joined back, so that Spark can split the
#: rows of a node with very many links among tasks.
MANY_LINKS = 5_000_000


def _star(pairs: DataFrame, many: bool) -> DataFrame:
    """Of rows (u, v): the rows with m, the least of u and its neighbours. Only one row a node is joined back."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = staged(least, "least") if many else least
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def components(links: DataFrame, many_links: int = MANY_LINKS) -> DataFrame:
    """node, component (its least node) of every node of ``links`` (a, b); nodes without links don't appear.

    Alternates two steps until nothing changes: each node passes its least neighbour on to the larger ones (large
    star), then links itself and its smaller neighbours to the least of them (small star). Each round is written
    to the shared folder, so lineage stays short. Null ends are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = staged(edges, "links"), None
    many = edges.count() >= many_links
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, many).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, many)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "links")
        state = tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)"))).first())
        if state == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        before = state
    raise RuntimeError("components did not settle")
