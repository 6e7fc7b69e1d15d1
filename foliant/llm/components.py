"""Connected components of links, in rounds of joins: no component is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.staging import drop, stage


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One half of a round: neighbours move to the smallest node that a node is linked with.

    ``both_ways``: a node sends its larger neighbours there (large star); else its smaller ones and itself (small star).
    The minimum is pre-aggregated per task and joined back, so a node with very many links is no bottleneck.
    """
    if both_ways:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.join(least, "a")
    if both_ways:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes in ``links`` (columns a and b).

    Large and small stars alternate until a round changes nothing; then every node points at the smallest one of
    its component. Links of a node with itself, links with null and repeated links have no effect.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
        after = stage(_stars(_stars(edges, both_ways=True), both_ways=False), "edges", rows=state["n"])
        drop(edges)
        edges = after

