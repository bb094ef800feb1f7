"""Connected components of an undirected graph given as an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; component is the smallest node reachable.

    Each round links every larger neighbour of a node to the smallest one, then every smaller neighbour likewise
    (large star, small star); the edges end as one star a component. A hub is never gathered: its minimum is a partly
    aggregated ``min`` and is joined back to its edges, which adaptive execution may split. Every round is written to
    the shared folder. Nulls and self loops: an edge with a null end is ignored, a self loop names its node.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = work.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.stage(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = work.stage(small.where("u <> v").distinct(), "small")
        work.drop(large, now)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
