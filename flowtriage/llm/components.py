"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtriage.sources.workspace import durable


def smallest_reachable(edges: DataFrame, nodes: DataFrame, node: str, label: str) -> DataFrame:
    """``node`` and component_id, the least non-null label of its component, for nodes with an edge.

    ``edges`` has columns a and b. Alternating large and small stars: each
    round joins every node's larger neighbours to its least one, then its
    smaller ones; a round is two aggregations and ends when nothing changes,
    after a number of rounds that grows with the logarithm of the diameter. A
    node's neighbours are reduced to their minimum before anything is joined,
    so a hub is a join key, never a collected list. Each round is written to
    the shared folder.
    """
    kept = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    fingerprint = None
    while True:
        both = kept.select("a", "b").unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: neighbours above a node move to its least neighbour.
        large = durable(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(),
            "large-star",
        )
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        kept = durable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "small-star",
        )
        now = kept.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == fingerprint:
            break
        fingerprint = tuple(now)
    member = kept.select(F.col("a").alias(node), F.col("b").alias("root"))
    member = member.unionByName(kept.select(F.col("b").alias(node), F.col("b").alias("root")).distinct())
    named = member.join(nodes.select(node, label), node)
    roots = named.groupBy("root").agg(F.min(label).alias("component_id"))
    return member.join(roots, "root").select(node, "component_id")
