"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import shared_dir


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst), root being the smallest node of its component.

    Each round joins the edges to the least neighbour of each node and is
    checkpointed; it ends when a round changes nothing. Edge counts never grow.
    """
    shared_dir(edges.sparkSession)

    def stars(e: DataFrame, large: bool) -> DataFrame:
        """Each edge is seen from both ends (large) or from its larger end; neighbours meet the least of them."""
        seen = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else e
        least = seen.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
        met = seen.join(least, "src")
        if large:
            met = met.filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        else:
            met = met.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))
        return met.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().checkpoint()
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = stars(stars(now, True), False).checkpoint()
        if (after := state(now)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
