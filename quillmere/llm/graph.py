"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from .common import lasting, remove, spread_join

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v): one row (u, v) for each node but the smallest of its component, v being that smallest.

    A round reads each node's neighbours; those of the few nodes with very many are spread over all tasks.
    """
    at, path = lasting(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
        if state == before or not state["n"]:
            return at
        before = state
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, old = lasting(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, path = lasting(large, path)
        least, old = lasting(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), old)
        small = spread_join(large, least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        at, path = lasting(small.distinct(), path)
        remove(edges.sparkSession, old)
