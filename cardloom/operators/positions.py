"""Global positions of rows without a global window, and what is sampled by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.sources.files import checkpoint

#: Fixed values of the sampler's generator: seed, multiplier and increment of its 64-bit state.
LCG_SEED, LCG_FACTOR, LCG_STEP = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407


def positions(rows: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """The rows with their positions, from 0, in the order of some columns, which should tell all rows apart.

    Rows are dealt out by ranges and sorted there; a position is the number of rows in earlier ranges, of which the driver
    holds one number each, and the place in the own range.
    """
    sort = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = checkpoint(sort.withColumns({"_range": F.shiftright("_at", 33).cast("int"), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = {r["_range"]: r["n"] for r in held.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for i in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(i, 0)
    start = F.get(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("_range")) if starts else F.lit(0).cast("long")
    return held.withColumn(name, start + F.col("_at")).drop("_at", "_range")


def drawn_positions(n: int, size: int) -> list[int]:
    """The positions of ``size`` of n keys, in the order in which a shuffle by the generator draws them: each step swaps the
    next place with one of those from it on. Only places that were swapped are remembered."""
    state, moved, out = LCG_SEED, {}, []
    for i in range(min(size, n)):
        state = (state * LCG_FACTOR + LCG_STEP) % (1 << 64)
        j = i + (state >> 33) % (n - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def drawn(keys: DataFrame, key: str, size: int) -> DataFrame:
    """(key): ``size`` of the distinct keys, drawn by position in their order; the same for the same keys."""
    placed = positions(keys.select(key).distinct(), key)
    return placed.where(F.col("position").isin(drawn_positions(placed.count(), size))).select(key)


def strided(rows: DataFrame, group: str, order: str, ceiling: int) -> DataFrame:
    """The rows (group, order) thinned to at most ``ceiling`` per group: every n-th by order from the first on, where n is the
    group's size over the ceiling, rounded up. A group of any size is spread over ranges, not gathered."""
    placed = positions(rows.select(group, order), group, order)
    sizes = placed.groupBy(group).agg(F.min("position").alias("first"), F.ceil(F.count("*") / ceiling).alias("step"))
    return placed.join(sizes, group).where((F.col("position") - F.col("first")) % F.col("step") == 0).select(group, order)
