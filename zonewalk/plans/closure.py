"""Transitive closure of dependency edges by semi-naive rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.plans.storage import stored

MAX_ROUNDS = 1000


def reachable(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """All (src, dst) with a path of one edge or more; edges: (src, dst). With seeds (src), only from those.

    Each round goes on only from the pairs that the round before found: with seeds by one edge, without by any path known,
    so that paths double. Raises RuntimeError beyond MAX_ROUNDS.
    """
    edges = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    start = edges if seeds is None else edges.join(seeds.select("src").distinct(), "src", "left_semi")
    found = new = stored(start, "paths")
    for _ in range(MAX_ROUNDS):
        step = (edges if seeds is not None else found).select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        longer = new.join(step, "dst").select("src", F.col("next").alias("dst"))
        new = stored(longer.distinct().join(found, ["src", "dst"], "left_anti"), "paths")
        if new.isEmpty():
            return found
        found = found.union(new)
    raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")
