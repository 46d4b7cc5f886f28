"""Connected components of an edge table by alternating large and small stars, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileframe.llm.common import materialise


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, component (least node reachable) for each node of an edge; edges has bigint columns a and b.

    Loops and repeated edges don't matter, NULL ends are left out, and no edges give no rows. Hubs are summed before
    they are joined, so that a hub of any degree is one aggregated row against joins that Spark can split.
    """
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        # Large star: u goes to the least neighbour of its lower end v. All edges of a hub v meet one row of a written table.
        least = materialise(now.groupBy("u").agg(F.min("v").alias("m")), "least").select(F.col("u").alias("at"), "m")
        large = now.join(least, F.col("v") == F.col("at"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
