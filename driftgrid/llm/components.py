"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the least node it reaches as ``root``, for every node of ``edges``.

    ``edges`` has columns ``u`` and ``v``; direction, repeats and loops do not matter.
    Alternating large and small stars: each round hangs a node's greater neighbours, then
    its lesser ones, on its least neighbour, so that chains shorten by half.  Least
    neighbours are partial minima, so a node with very many edges costs no single task its
    rows.  Each round's edges are written to the shared folder.
    """
    now = cut_lineage(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: greater neighbours hang on the least one.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: now every edge leads down; lesser neighbours hang on the least one.
        large = cut_lineage(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        now = cut_lineage(small.where("u <> v").distinct(), "small")
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
