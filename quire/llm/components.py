"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import table


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b: long).

    ``component`` is the smallest node reachable.  Each round replaces the
    edges: first every larger neighbour of a node points to the node's
    smallest neighbour, then every smaller one does.  Groups only take a
    minimum (combined before the shuffle), never a list, so a node with any
    number of links is no more work than its links.  Every round is a table
    in the shared folder; the rounds end when nothing changes.  Self loops and
    repeated edges have no effect; an empty table gives an empty result.
    """
    cur = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a is not null and b is not null and a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        cur = table(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
