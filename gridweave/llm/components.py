"""Connected components of a graph given by its edges, by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import drop_stored, stored


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``edges`` (a long, b long) to (node long, component long): the least node that each node is connected with.

    Loops and repeated edges do nothing, edges with a null end are left out, no edges give no rows. Each step is a
    few shuffles of the edges; minima are combined before they are shuffled and the joins have plain exchanges, so a
    node with very many neighbours is split. Every step is written to the shared folder.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join below has a plain exchange on either side and a node with most of the edges is split.
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        after = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(now)
        drop_stored(least)
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"no fixed point after {most} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
