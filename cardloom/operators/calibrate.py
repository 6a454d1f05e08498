"""Calibration of activation floors, and the histogram that shows how alike notes are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.operators.knn import nearest
from cardloom.operators.positions import drawn

SAMPLE, LEAST, MARGIN, BUCKETS = 256, 30, 1.0, 20


def sample_keys(keys: DataFrame, size: int = SAMPLE, lowest: bool = False) -> DataFrame:
    """(note_id): ``size`` notes with vectors, drawn by a fixed generator from their ids in order; or the ``lowest`` ids."""
    if lowest:
        return keys.select("note_id").distinct().orderBy("note_id").limit(size)
    return drawn(keys, "note_id", size)


def activation_stats(vectors: DataFrame, sample: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row (n, mean, std): the sampled notes' best similarity to another note; std over the population.

    mean and std are null below LEAST samples. ``queries`` gives the sampled notes other vectors to search by (note_id, vec),
    such as their texts' vectors against image vectors.
    """
    by = vectors if queries is None else queries
    first = (by.groupBy("note_id").agg(F.min_by("vec", "item").alias("vec")) if "item" in by.columns else by.select("note_id", "vec")).join(sample, "note_id", "left_semi")
    bank = first.select(F.col("note_id").alias("query_id"), "vec")
    best = nearest(bank, vectors, 1, exclude=bank.select("query_id", F.col("query_id").alias("note_id")))
    told = best.agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"))
    enough = F.col("n") >= LEAST
    return told.select("n", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.col("std")).alias("std"))


def floor_of(stats: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(floor): mean + margin * std; null where there are too few samples."""
    return stats.select((F.col("mean") + margin * F.col("std")).alias("floor"))


def secondary_floors(images: DataFrame, texts: DataFrame, size: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """(space, n, floor): for each space of image vectors (space, note_id, vec) its activation floor.

    Sampled notes that have both search the other notes' images by their text vectors (space, note_id, vec) of the same
    space; the floor is mean + margin * std of their best similarities, null below LEAST of them. Spaces are few.
    """
    out = None
    sample = sample_keys(images.select("note_id").join(texts.select("note_id"), "note_id", "left_semi"), size)
    for space in sorted(r.space for r in images.select("space").distinct().collect()):
        told = activation_stats(images.where(F.col("space") == space), sample, texts.where(F.col("space") == space).select("note_id", "vec"))
        one = told.select(F.lit(space).alias("space"), "n", (F.col("mean") + margin * F.col("std")).alias("floor"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else images.sparkSession.createDataFrame([], "space string, n long, floor double")


def bucket(best: Column) -> Column:
    return F.greatest(F.least(F.floor(best * BUCKETS).cast("int"), F.lit(BUCKETS - 1)), F.lit(0))


def duplicate_histogram(best: DataFrame) -> DataFrame:
    """(bucket, n) over 20 buckets, of (note_id, best); notes without a match are under a null bucket."""
    counts = best.groupBy(F.when(F.col("best").isNotNull(), bucket(F.col("best"))).alias("bucket")).agg(F.count("*").alias("n"))
    every = best.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).unionByName(counts.where("bucket is null"))
