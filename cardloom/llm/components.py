"""Connected components by repeated star operations, without gathering a node's links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import checkpoint


def _least_neighbour(links: DataFrame) -> DataFrame:
    """For each node its least neighbour or itself; a partial aggregate, so a node of many links is no hot task."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component; nodes without a link to another node aren't returned.

    Large-star and small-star steps alternate until nothing moves, which leaves a star around each component's least
    node. Only counts and one hash come to the driver. Lineage is cut every round. Raises if ``rounds`` don't suffice,
    which takes components of diameter beyond any 2 ** 20.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    now = checkpoint(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both)
        # large star: a node's greater neighbours move to its least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least_neighbour(large)
        # small star: a node and its lesser neighbours move to the least one
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = checkpoint(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(state)
    raise RuntimeError("components: the star operations didn't end")
