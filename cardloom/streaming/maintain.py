"""Structured Streaming upkeep: change rows in, a derived table and its watermark kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.operators.incremental import drain_merge
from cardloom.schema import CHANGES
from cardloom.sources.buckets import Buckets


def apply_batch(table: Buckets, rows: DataFrame, number: int, notes: DataFrame, derive: Callable[[DataFrame], DataFrame], carry: Column | None = None) -> int:
    """Bring the table past a batch of change rows; the version.

    The batch comes to the last change per note; maintained notes are derived anew, removed ones go. Only the buckets of these
    notes are read and written. Rows for which ``carry`` holds (recognised texts, which notes don't give) stay as long as
    their note does. The rows, the watermark, its floor and the batch number appear in one manifest, so a batch that is run
    again after a failure either finds itself done or starts from the table as it was.
    """
    was = table.note()
    if was.get("batch", -1) >= number:
        return table.version()
    actions = drain_merge(rows, notes)
    touched = table.touched(actions)
    fresh = derive(notes.join(actions.where("action = 'maintain'"), "note_id", "left_semi"))
    old = table.read(buckets=touched)
    stays = F.col("action").isNull()
    if carry is not None:
        stays = stays | ((F.col("action") == "maintain") & carry)
    kept = old.join(actions, "note_id", "left").where(stays).select(old.columns)
    failed = rows.agg(F.min(F.when(~F.col("success"), F.col("col_mod")))).first()[0]
    floor = min((x for x in (failed, was.get("floor")) if x is not None), default=None)
    good = F.col("success") if floor is None else F.col("success") & (F.col("col_mod") < floor)
    certified = rows.where(good).agg(F.max("col_mod")).first()[0]
    mark = max((x for x in (certified, was.get("watermark")) if x is not None), default=None)
    return table.rewrite(touched, kept.unionByName(fresh.select(old.columns)), {"batch": number, "watermark": mark, "floor": floor})


def maintain(changes: DataFrame, notes: Callable[[], DataFrame], table: Buckets, checkpoint: str, derive: Callable[[DataFrame], DataFrame], carry: Column | None = None, **trigger: object) -> StreamingQuery:
    """Start the upkeep of a derived table (note_id, ...) in buckets by note_id, from a stream of change rows (note_id,
    col_mod, kind, success); ``apply_batch`` says what each batch does."""

    def batch(rows: DataFrame, number: int) -> None:
        apply_batch(table, rows, number, notes(), derive, carry)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_changes(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Change rows from files as they arrive."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", per_trigger).parquet(folder)
