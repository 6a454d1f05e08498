"""Tags as concepts: membership through the hierarchy, centroids, and the tag signal of a search."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.vectors import inner_product, round3
from cardloom.operators.knn import nearest, small_bank
from cardloom.operators.positions import positions, strided
from cardloom.operators.vector_join import block_best

BLOCKED = ("leech", "marked")
ACTIVATION, TOP_TAGS, RANK_CAP = 0.35, 3, 50


def prefixes(name: Column | str) -> Column:
    """``a::b::c`` as [a, a::b, a::b::c]."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))


def membership(notes: DataFrame) -> DataFrame:
    """(tag, note_id): every note under each of its tags and their ancestors, once."""
    return notes.select("note_id", F.explode("tags").alias("leaf")).select("note_id", F.explode(prefixes("leaf")).alias("tag")).distinct().select("tag", "note_id")


def centroids(members: DataFrame, vectors: DataFrame, n_notes: int, min_members: int = 2, max_coverage: float = 0.5, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(tag, members, embedded, vec): the normalised mean of the members' first text vectors.

    Left out: tags of few members, tags that cover too many notes, blocked segments, and those of fewer than two vectors or
    no length. Sums are partial aggregates by (tag, component), so a tag of many members is no hot task.
    """
    size = members.groupBy("tag").agg(F.count("*").alias("members")).where((F.col("members") >= min_members) & (F.col("members") <= max_coverage * n_notes))
    size = size.where(~F.exists(F.split("tag", "::"), lambda s: F.lower(s).isin(*blocked)))
    first = vectors.groupBy("note_id").agg(F.min_by("vec", "item").alias("vec"))
    held = members.join(size, "tag").join(first, "note_id")
    sums = held.select("tag", "members", "note_id", F.posexplode("vec").alias("at", "x")).groupBy("tag", "members", "at").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("embedded"))
    whole = sums.groupBy("tag", "members").agg(F.max("embedded").alias("embedded"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("parts"))
    vec = F.transform("parts", lambda p: p["x"])
    length = F.sqrt(inner_product(vec, vec))
    return whole.where((F.col("embedded") >= 2) & (length > 1.1920929e-07)).select("tag", "members", "embedded", F.transform(vec, lambda x: x / length).alias("vec"))


def tag_signal(queries: DataFrame, tags: DataFrame, members: DataFrame, vectors: DataFrame, activation: float = ACTIVATION, top_tags: int = TOP_TAGS, cap: int = RANK_CAP, ceiling: int | None = None) -> DataFrame:
    """(query_id, note_id, rank): members of the query's best tags; the best tag's first, by their own similarity.

    A member is ranked under its best tag alone. Every member of those tags is scored, however many a tag has, unless
    ``ceiling`` thins each tag's members by position. A small bank goes to the members' vectors, each partition keeps ``cap``
    per query, and one window merges them; the queries of a larger one meet their tags' members in blocks.
    """
    named = positions(tags.select("tag", "vec"), "tag", name="note_id")
    active = nearest(queries, named, top_tags).where(F.col("sim") >= activation).withColumnRenamed("note_id", "at").withColumnRenamed("rank", "tag_rank")
    active = active.join(named.select(F.col("note_id").alias("at"), "tag"), "at").select("query_id", "tag_rank", "tag")
    first = vectors.groupBy("note_id").agg(F.min_by("vec", "item").alias("own")).where("own is not null")
    if ceiling is not None:
        members = strided(members, "tag", "note_id", ceiling)
    asked = queries.select("query_id", "vec").where("vec is not null").join(active, "query_id")
    if small_bank(queries) is None:
        wanted = members.join(active.select("tag").distinct(), "tag", "left_semi").join(first, "note_id").select(F.col("tag").alias("cell"), "note_id", F.col("own").alias("vec"))
        # of a note in several tags some tag's cap may be taken by notes of a better tag: no more than that tag has, so enough are left
        best = block_best(wanted, asked.select(F.col("tag").alias("cell"), "query_id", "vec", F.lit(cap).alias("keep"), F.col("tag_rank").alias("level")))
        found = best.groupBy("query_id", "note_id").agg(F.min("level").alias("tag_rank"), F.max("sim").alias("dot"))
    else:
        block = asked.groupBy("query_id").agg(F.first("vec").alias("vec"), F.collect_list(F.struct("tag_rank", "tag")).alias("active")).collect()
        spark = queries.sparkSession
        if not block:
            return spark.createDataFrame([], "query_id long, note_id long, tag_rank int, score double, rank int")
        wanted = spark.createDataFrame(sorted({(a.tag,) for r in block for a in r.active}), "tag string")
        reached = members.join(F.broadcast(wanted), "tag", "left_semi").groupBy("note_id").agg(F.collect_set("tag").alias("tags"))
        found = reached.join(first, "note_id").select("note_id", "tags", "own").mapInArrow(_members(block, cap), "query_id long, note_id long, tag_rank int, dot double")
    order = Window.partitionBy("query_id").orderBy("tag_rank", F.desc("dot"), "note_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("query_id", "note_id", "tag_rank", round3("dot").alias("score"), "rank")


def _members(block: list, cap: int):
    """From (note_id, tags, own): each query's first ``cap`` members by tag rank, product and id."""
    bank = [(r.query_id, np.array(r.vec, dtype=np.float64), sorted(((a.tag_rank, a.tag) for a in r.active), reverse=True)) for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, dtype=np.int32), np.zeros(0), np.zeros(0, dtype=np.int64))] * len(bank)
        for batch in batches:
            if not batch.num_rows:
                continue
            notes = batch.column(0).to_numpy()
            matrix = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(len(notes), -1)
            rows_of = defaultdict(list)
            for row, own in enumerate(batch.column(1).to_pylist()):
                for tag in own:
                    rows_of[tag].append(row)
            rows_of = {tag: np.array(rows) for tag, rows in rows_of.items()}
            for at, (_, query, active) in enumerate(bank):
                held = [(rank, rows_of[tag]) for rank, tag in active if tag in rows_of]
                if not held:
                    continue
                rank_of = np.zeros(len(notes), dtype=np.int32)
                for rank, rows in held:  # the best tag comes last
                    rank_of[rows] = rank
                rows = np.flatnonzero(rank_of)
                dots = np.zeros(len(rows))
                for column in range(matrix.shape[1]):  # in the components' order, as column expressions add them
                    dots += matrix[rows, column] * query[column]
                ranks, dots, ids = (np.concatenate(x) for x in zip(best[at], (rank_of[rows], dots, notes[rows]), strict=True))
                keep = np.lexsort((ids, -dots, ranks))[:cap]
                best[at] = (ranks[keep], dots[keep], ids[keep])
        for (query_id, _, _), (ranks, dots, ids) in zip(bank, best, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query_id, dtype=np.int64)), pa.array(ids), pa.array(ranks), pa.array(dots)], names=["query_id", "note_id", "tag_rank", "dot"])

    return run


def unused_tags(registry: DataFrame, notes: DataFrame) -> DataFrame:
    """(tag): registered tags that no note has, itself or below, whatever the case."""
    used = membership(notes).select(F.lower("tag").alias("used")).distinct()
    return registry.join(used, F.lower("tag") == F.col("used"), "left_anti")
