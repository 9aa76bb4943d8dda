"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) that is looked
up for the edges by node and salt, so a hub with very many links is spread over
many tasks; each round is cut by ``checkpoint()`` into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .salted import look_up

EDGES_PER_FILE = 250_000


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over directed rows (u, v), which must lie still (checkpointed); see ``components``."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    moved = look_up(edges, ["u"], least)
    if larger_only:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    low = moved.filter("v < u")
    return (low.select(F.col("v").alias("u"), F.col("_m").alias("v"))
            .unionByName(low.select("u", F.col("_m").alias("v"))).filter("u != v"))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns u, v.  Returns (node, root) for every node that has an edge; root is the least node."""
    checkpoint_root(edges.sparkSession)
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    # a round has hardly more edges than the one before: about as many files as they fill
    kept = lambda df, n: df.distinct().coalesce(max(1, -(-n // EDGES_PER_FILE))).checkpoint()
    now = kept(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), edges.count())
    seen = None
    while (state := tuple(now.agg(*mark).first())) != seen:
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept(_towards_least(both, True), state[0])
        now = kept(_towards_least(large, False), state[0])
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
