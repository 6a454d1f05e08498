"""Incremental upkeep: what changed, what a batch of changes comes to, and how far a watermark may advance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(payloads: DataFrame, algorithm: str = "blake2b8") -> DataFrame:
    """(note_id, hash) of (note_id, payload). ``sha256`` stays in the JVM."""
    from cardloom.functions.hashing import blake2b8_hex

    return payloads.select("note_id", (F.sha2("payload", 256) if algorithm == "sha256" else blake2b8_hex("payload")).alias("hash"))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(note_id, action embed/remove) that lead from the old fingerprints to the new; no rows where nothing changed."""
    both = old.withColumnRenamed("hash", "was").join(new.withColumnRenamed("hash", "now"), "note_id", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("note_id", F.when(F.col("now").isNull(), "remove").otherwise("embed").alias("action"))


def drifted(meta: dict | None, col_mod: int, model: str | None, embeds_images: bool, schema: int) -> bool:
    """Whether an index is behind: none, no stamp, another model, an old layout for images, or another col_mod."""
    if not meta or not meta.get("ndim") or meta.get("col_mod") is None:
        return True
    if model is not None and meta.get("model_id") != model:
        return True
    return meta.get("schema", 0) < schema and embeds_images or meta["col_mod"] != col_mod


def drain_merge(changes: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_id, action maintain/remove): the last change of each note in a batch; one that isn't there is removed.

    ``changes``: note_id, col_mod, kind (Maintain, Remove, AdvanceOnly); AdvanceOnly touches no note.
    """
    last = changes.where("kind <> 'AdvanceOnly'").groupBy("note_id").agg(F.max_by("kind", "col_mod").alias("kind"))
    there = notes.select("note_id").distinct().withColumn("there", F.lit(True))
    return last.join(there, "note_id", "left").select("note_id", F.when((F.col("kind") == "Maintain") & F.col("there"), "maintain").otherwise("remove").alias("action"))


def watermarks(changes: DataFrame, group: str, order: str = "seq") -> DataFrame:
    """(group, seq, watermark, floor) after each change of (group, seq, col_mod, success, clear).

    A failure sets the floor to the lowest failed col_mod; success advances to its col_mod unless a floor is at or below it;
    ``clear`` heals. The watermark is the greatest certified value so far. A group is one index's log, read in order.
    """
    by = Window.partitionBy(group).orderBy(order)
    logged = changes.withColumn("era", F.sum(F.when(F.col("clear"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    era = Window.partitionBy(group, "era").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    logged = logged.withColumn("floor", F.min(F.when(~F.col("success") & ~F.col("clear"), F.col("col_mod"))).over(era))
    certified = F.when(F.col("clear"), F.col("col_mod")).when(F.col("success") & (F.col("floor").isNull() | (F.col("floor") > F.col("col_mod"))), F.col("col_mod"))
    logged = logged.withColumn("certified", certified)
    return logged.select(group, order, F.max("certified").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("watermark"), "floor")


def upsert_rows(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of ``fresh`` in place of all that share their keys."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the last one."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_at = 1").drop("_at")


def refresh_frequency(df: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(term, df) after some segments' postings changed: the difference of the touched terms alone is counted."""
    change = after.select("term", F.lit(1).alias("d")).unionByName(before.select("term", F.lit(-1).alias("d"))).groupBy("term").agg(F.sum("d").alias("d"))
    return df.join(change, "term", "full").select("term", (F.coalesce("df", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("df")).where("df > 0")


def judge(recognition: Column | None = None, least_confidence: float = 0.5, least_chars: int = 4, vector_chars: int = 20) -> Column:
    """What a recognised text (columns text, confidence) may feed: drop, lexical, lexical_and_vector."""
    chars = F.length(F.trim("text"))
    return F.when((F.col("confidence") < least_confidence) | (chars < least_chars) | F.col("text").isNull(), "drop").when(chars >= vector_chars, "lexical_and_vector").otherwise("lexical")


#: Where recognised text goes by its source.
PURPOSES = {"ocr": ("lexical", "vector"), "asr": ("lexical", "vector"), "vlm": ("vector",)}


def route(recognitions: DataFrame) -> DataFrame:
    """The recognitions with outcome, and lexical and vector: whether they feed each."""
    judged = recognitions.withColumn("outcome", judge())
    may = lambda use: F.col("source").isin(*[s for s, uses in PURPOSES.items() if use in uses])
    return judged.withColumns({"lexical": may("lexical") & (F.col("outcome") != "drop"), "vector": may("vector") & (F.col("outcome") == "lexical_and_vector")})


def pending(refs: DataFrame, done: DataFrame, gated: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """(note_id, ref) still to recognise: neither done nor dropped; markers of another recogniser don't count."""
    marks = done.unionByName(gated, allowMissingColumns=True)
    if fingerprint is not None:
        marks = marks.where(F.col("fingerprint") == fingerprint)
    return refs.select("note_id", "ref").distinct().join(marks.select("note_id", "ref").distinct(), ["note_id", "ref"], "left_anti")


def sweep(refs: DataFrame, recognise, chunk: int = 512) -> DataFrame:
    """Recognitions of pending refs by an injected function from a pandas batch to (note_id, ref, text, confidence) rows."""
    schema = "note_id long, ref string, text string, confidence double"
    return refs.repartition(max(1, -(-refs.count() // chunk)), "note_id", "ref").mapInPandas(lambda batches: map(recognise, batches), schema)
