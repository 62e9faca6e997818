"""Connected components of a link table, by rounds of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Alternates large stars (each node ties its larger neighbours to its
    smallest one) and small stars (ties its smaller neighbours to the
    smallest), which ends after about log(n) rounds. A star's centre is found
    by a partial minimum, so a node with very many links is no hot group; the
    join back is one that Spark splits by skew. Links to null, and from a node
    to itself, are left out; the table may be empty or hold repeated links.
    """
    edges = store(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a > b").distinct(),
        "links",
    )
    before = None
    while True:
        large = _star(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        edges = store(_star(large, larger=False), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node u with smallest neighbour m (itself included): its neighbours are tied to m."""
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = edges.join(low, "a")
    if larger:
        tied = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return tied.filter("a > b").distinct()
