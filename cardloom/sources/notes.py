"""Sources: notes, cards, segments and vectors from stored tables, packages, media folders; and sinks for them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions.text import glob_pattern, image_refs, mime_type, safe_media_name, sound_refs
from cardloom.schema import FIELD_SEPARATOR


def split_fields(raw: Column, names: Column) -> Column:
    """A separator-joined value against field names, as an array of (ord, name, value)."""
    values = F.split(raw, FIELD_SEPARATOR)
    return F.transform(F.arrays_zip(names.alias("name"), values.alias("value")), lambda f, i: F.struct(i.cast("int").alias("ord"), f["name"].alias("name"), F.coalesce(f["value"], F.lit("")).alias("value")))


def scan_fields(notes: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """(note_id, note_type, fields) of the ids in their order (column at); missing ones are skipped."""
    if isinstance(ids, DataFrame):
        wanted = ids
    else:
        wanted = notes.sparkSession.createDataFrame(list(enumerate(ids)), "at long, note_id long")
    return wanted.join(notes.select("note_id", "note_type", "fields"), "note_id").select("at", "note_id", "note_type", "fields").orderBy("at")


def typed_notes(raw: DataFrame, types: DataFrame, cards: DataFrame, decks: DataFrame, with_fields: bool = True) -> DataFrame:
    """Notes with their type's name and the deck of their first card (least ord); ``Unknown`` and ``Default`` where missing."""
    first = cards.groupBy("note_id").agg(F.min_by("deck_id", F.struct("ord", "card_id")).alias("deck_id"))
    joined = raw.join(types.select(F.col("type_id"), F.col("name").alias("type_name"), F.transform("fields", lambda f: f["name"]).alias("names")), "type_id", "left")
    joined = joined.join(first, "note_id", "left").join(decks.select("deck_id", F.col("name").alias("deck_name")), "deck_id", "left")
    fields = split_fields(F.col("flds"), F.col("names")) if with_fields else F.lit(None).cast("array<struct<ord:int,name:string,value:string>>")
    tags = F.filter(F.split(F.trim("tags"), r"\s+"), lambda t: t != "")
    return joined.select("note_id", F.coalesce("type_name", F.lit("Unknown")).alias("note_type"), F.coalesce("deck_name", F.lit("Default")).alias("deck"), tags.alias("tags"), "modified", fields.alias("fields"))


def field_segments(notes: DataFrame, blanks: bool = False) -> DataFrame:
    """(note_id, source ``field``, ref, text): one row per field, those that are blank left out unless asked for."""
    rows = notes.select("note_id", F.explode("fields").alias("f")).select("note_id", F.lit("field").alias("source"), F.col("f.name").alias("ref"), F.col("f.ord").alias("ord"), F.col("f.value").alias("text"))
    return rows if blanks else rows.where("trim(text) <> ''")


def numbered(segments: DataFrame) -> DataFrame:
    """Segments with seg_id, in the order of note and field, which is the order that ties follow.

    Numbers are (note_id, place in the note) packed, so no global sort is needed: a note has less than 2 ** 20 segments.
    """
    order = Window.partitionBy("note_id").orderBy(*([F.col("ord")] if "ord" in segments.columns else []), "source", "ref")
    return segments.withColumn("seg_id", F.col("note_id") * (1 << 20) + F.row_number().over(order)).select("seg_id", "note_id", "source", "ref", "text")


def tag_rows(raw: DataFrame) -> DataFrame:
    """(note_id, tags) of notes that have tags."""
    tags = F.filter(F.split(F.trim("tags"), r"\s+"), lambda t: t != "")
    return raw.select("note_id", tags.alias("tags")).where("size(tags) > 0")


def media_refs(notes: DataFrame) -> DataFrame:
    """(note_id, kind, names): image and sound files that notes name, in order; a cheap test goes before the parsing."""
    rows = notes.select("note_id", F.explode("fields").alias("f")).select("note_id", F.col("f.ord").alias("ord"), F.col("f.value").alias("value"))
    low = F.lower("value")
    parts = []
    for kind, mark, refs in (("image", "<img", image_refs), ("sound", "[sound:", sound_refs)):
        some = rows.where(F.contains(low, F.lit(mark))).select("note_id", "ord", refs("value").alias("names"))
        each = some.groupBy("note_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "names"))), lambda x: x["names"]))).alias("names"))
        parts.append(each.where("size(names) > 0").select("note_id", F.lit(kind).alias("kind"), "names"))
    return parts[0].unionByName(parts[1])


def list_media(spark: SparkSession, folder: str, glob: str | None = None, limit: int = 0) -> tuple[DataFrame, int]:
    """(name, mime, size, url, path) of a folder's files by name, and their number before the limit."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    listed = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), "path")
    if glob:
        listed = listed.where(F.col("name").rlike(glob_pattern(glob)))
    out = listed.select("name", mime_type("name").alias("mime"), "size", F.concat(F.lit("media/"), "name").alias("url"), "path").orderBy("name")
    return (out.limit(limit) if limit else out), out.count()


def fetch_media(names: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, status found/missing, size, mime) for each asked name."""
    return names.join(listing.select("name", "size", "mime"), "name", "left").select("name", F.when(F.col("size").isNotNull(), "found").otherwise("missing").alias("status"), "size", "mime")


def store_media(items: DataFrame, listing: DataFrame, most: int = 64 << 20) -> DataFrame:
    """(name, status, size, error) of items (name, data in base64): what would be stored; content is ``unbase64(data)``."""
    checked = items.withColumns({"safe": safe_media_name("name"), "content": F.expr("try_to_binary(data, 'base64')")})
    error = F.when(F.col("safe").isNull(), "bad name").when(F.col("content").isNull(), "bad data").when(F.octet_length("content") > most, "too large")
    told = checked.withColumn("error", error).join(listing.select(F.col("name").alias("taken")).withColumn("there", F.lit(True)), F.col("safe") == F.col("taken"), "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("there"), "replaced").otherwise("stored")
    return told.select(F.coalesce("safe", "name").alias("name"), status.alias("status"), F.octet_length("content").alias("size"), "error", F.when(F.col("error").isNull(), F.col("content")).alias("content"))


def write_media(checked: DataFrame, folder: str) -> DataFrame:
    """Write the content of what ``store_media`` lets pass; the same rows without content, an error where a write failed.

    Each task writes its own files, under another name at first and then renamed, so that a file is there whole or not at all
    and a task that runs again gives the same files. Of items that
    share a name one is kept. ``folder``: a path or an address that Arrow's file systems open.
    """
    schema = "name string, status string, size int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        store, base = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", place))
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                content = row.pop("content")
                if content is None:
                    continue
                draft = f"{base}/.{uuid.uuid4().hex}"
                try:
                    with store.open_output_stream(draft) as out:
                        out.write(content)
                    store.move(draft, f"{base}/{row['name']}")
                except OSError as failed:
                    row |= {"status": "error", "error": str(failed)}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.string()), ("status", pa.string()), ("size", pa.int32()), ("error", pa.string())]))

    return checked.select("name", "status", "size", "error", "content").repartition("name").mapInArrow(run, schema)


def delete_media(names: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, status deleted/not_found)."""
    there = listing.select("name", F.lit(True).alias("there"))
    return names.select("name").distinct().join(there, "name", "left").select("name", F.when(F.col("there"), "deleted").otherwise("not_found").alias("status"))


def export_package(notes: DataFrame, folder: str, deck: str | None = None, ids: DataFrame | None = None) -> int:
    """Write notes (all, a deck with its children, or ids) as Parquet; returns their number."""
    scoped = notes
    if deck is not None:
        scoped = scoped.where((F.col("deck") == deck) | F.col("deck").startswith(deck + "::"))
    if ids is not None:
        scoped = scoped.join(ids.select("note_id"), "note_id", "left_semi")
    scoped.write.mode("overwrite").parquet(folder)
    return notes.sparkSession.read.parquet(folder).count()


def import_package(existing: DataFrame, incoming: DataFrame, policy: str = "if_newer") -> tuple[DataFrame, DataFrame]:
    """The merged notes by guid, and the counts (bucket, n): new, updated, duplicate, conflicting.

    ``policy``: ``if_newer`` takes later incoming rows, ``always`` all, ``never`` only new ones. An incoming note of another
    type than the existing one conflicts and changes nothing.
    """
    ours, theirs = existing.select(F.struct("*").alias("ours"), F.col("guid")), incoming.select(F.struct(*existing.columns).alias("theirs"), F.col("guid"))
    both = ours.join(theirs, "guid", "full")
    newer = {"if_newer": F.col("theirs.modified") > F.col("ours.modified"), "always": F.lit(True), "never": F.lit(False)}[policy]
    bucket = F.when(F.col("theirs").isNull(), "kept").when(F.col("ours").isNull(), "new").when(F.col("ours.note_type") != F.col("theirs.note_type"), "conflicting").when(newer, "updated").otherwise("duplicate")
    judged = both.withColumn("bucket", bucket)
    # an existing note keeps its own id
    row = F.when(F.col("bucket") == "new", F.col("theirs")).when(F.col("bucket") == "updated", F.col("theirs").withField("note_id", F.col("ours.note_id"))).otherwise(F.col("ours"))
    return judged.select(row.alias("row")).select("row.*"), judged.where("bucket <> 'kept'").groupBy("bucket").agg(F.count("*").alias("n"))


def save_index(vectors: DataFrame, folder: str) -> None:
    """A file set per space and modality; stale ones go with the folder's old content."""
    vectors.write.mode("overwrite").partitionBy("space", "modality").parquet(folder)


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
