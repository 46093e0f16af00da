"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): large-star links the larger neighbours of each u to its smallest one, small-star the others."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where(F.col("v") < F.col("u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); the component is its smallest node.

    No edges give no rows. The edge set is written to the shared folder each round and never collected.
    Raises RuntimeError if MAX_ROUNDS do not suffice.
    """
    spark = edges.sparkSession
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        after = materialise(_star(_star(now, True), False), "edges")
        got = after.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        now = after
        if (got.n, got.h) == mark or got.n == 0:
            break
        mark = (got.n, got.h)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
