"""Exact nearest notes for a bank of query vectors.

A bank of at most BLOCK queries goes to the vectors as it is; each partition keeps its own best notes per query by matrix
products, and one window merges them. A larger bank stays a table and meets the vectors cell by cell (``vector_join``). So
the shuffle never holds a row per query and vector, and what the driver carries is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.vectors import round3
from cardloom.operators.vector_join import best_pairs, exact_products, matrix_of, nearest_dealt

BLOCK = 4096
#: Products that a task holds at a time; vectors of a block at least and at most, and the number up to which blocks stay small.
PRODUCTS, LEAST_SHARD, MOST_SHARD, MOST_SHARDS = 1 << 20, 8192, 65_536, 64


def small_bank(queries: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids and vectors of a bank of at most BLOCK queries, in order; None for a larger one."""
    rows = queries.select("query_id", "vec").where("vec is not null").limit(BLOCK + 1).collect()
    if len(rows) > BLOCK:
        return None
    rows.sort(key=lambda r: (r.query_id, r.vec))
    return np.array([r.query_id for r in rows], dtype=np.int64), np.array([r.vec for r in rows], dtype=np.float64)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, scope: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, note_id, sim, rank): the k notes of the greatest similarity, each by its own best vector.

    ``queries``: query_id, vec; ``vectors``: note_id, vec (several per note may be). Ties go to the smaller note_id. ``scope``
    is applied before the search, ``exclude`` (query_id, note_id) after as many more have been kept.
    """
    plain = vectors.select("note_id", "vec").where("vec is not null")
    if scope is not None:
        plain = plain.join(scope.select("note_id"), "note_id", "left_semi")
    bank = small_bank(queries)
    if bank is None:
        found = nearest_dealt(queries, plain, k, exclude)
    elif not len(bank[0]):
        return queries.sparkSession.createDataFrame([], "query_id long, note_id long, sim double, rank int")
    else:
        extra = 0 if exclude is None else (exclude.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
        found = plain.mapInArrow(_local(*bank, k + extra), "query_id long, note_id long, sim double")
        if exclude is not None:
            found = found.join(exclude.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")
    best = found.groupBy("query_id", "note_id").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "note_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _local(ids: np.ndarray, bank: np.ndarray, k: int):
    """Each partition's own best notes per query; its batches' best are merged as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.full(len(ids), k)
        at, notes, sims = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = best_pairs(batch.column(0).to_numpy(), matrix_of(batch.column(1), batch.num_rows), bank, keep)
            at, notes, sims = (np.concatenate(x) for x in zip((at, notes, sims), found, strict=True))
            if len(at) > 4 * k * len(ids):
                at, notes, sims = _merge(at, notes, sims, k)
        at, notes, sims = _merge(at, notes, sims, k)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(notes), pa.array(sims)], names=["query_id", "note_id", "sim"])

    return run


def _merge(at: np.ndarray, notes: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best notes, every note once."""
    order = np.lexsort((-sims, notes, at))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (at[order][1:] != at[order][:-1]) | (notes[order][1:] != notes[order][:-1])
    order = order[first]
    order = order[np.lexsort((notes[order], -sims[order], at[order]))]
    order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < k]
    return at[order], notes[order], sims[order]


def best_in_bank(vectors: DataFrame, queries: DataFrame, itself: bool = False) -> DataFrame:
    """(note_id, best): each note's greatest similarity to a query of the bank; ``itself``: to one of its own id too.

    A small bank meets each vector where it is read. A larger one stays a table, and its blocks meet blocks of the vectors.
    """
    plain = vectors.select("note_id", "vec").where("vec is not null")
    bank = small_bank(queries)
    if bank is None:
        best = _best_dealt(plain, queries.select("query_id", "vec").where("vec is not null"), itself)
    elif not len(bank[0]):
        return plain.select("note_id", F.lit(None).cast("double").alias("best")).limit(0)
    else:
        best = plain.mapInArrow(lambda batches: bank_batches(batches, *bank, itself), "note_id long, best double")
    return best.groupBy("note_id").agg(F.max("best").alias("best"))


def bank_batches(batches: Iterator[pa.RecordBatch], ids: np.ndarray, bank: np.ndarray, itself: bool) -> Iterator[pa.RecordBatch]:
    """(note_id, best) of batches of (note_id, vec), PRODUCTS of them at a time."""
    step = max(1, PRODUCTS // len(ids))
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            notes = part.column(0).to_numpy()
            own = matrix_of(part.column(1), len(notes))
            estimates = own @ bank.T
            if not itself:
                estimates[notes[:, None] == ids] = -np.inf
            top = np.maximum(estimates.max(axis=1), -np.where(np.isfinite(estimates), estimates, 0.0).min(axis=1))
            floor = estimates.max(axis=1) - 1e-9 * (1 + np.abs(top))
            at, which = np.nonzero((estimates >= floor[:, None]) & np.isfinite(estimates))
            best = np.full(len(notes), -np.inf)
            np.maximum.at(best, at, exact_products(own, bank, at, which))
            some = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(notes[some], pa.int64()), pa.array(best[some], pa.float64())], names=["note_id", "best"])


def _best_dealt(vectors: DataFrame, queries: DataFrame, itself: bool) -> DataFrame:
    """(note_id, best) of each block of the bank: every block of vectors meets every block of queries in a task of its own."""
    n, asked = vectors.count(), queries.count()
    shards = max(1, min(MOST_SHARDS, -(-n // LEAST_SHARD)), -(-n // MOST_SHARD))
    blocks = -(-asked // MOST_SHARD)
    place = lambda of, *c: F.pmod(F.xxhash64(*c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    own = vectors.select(F.col("note_id").cast("long").alias("id"), "vec", place(shards, "note_id", "vec").alias("shard"), every(blocks).alias("block"))
    bank = queries.select(F.col("query_id").cast("long").alias("id"), "vec", place(blocks, "query_id", "vec").alias("block"), every(shards).alias("shard"))

    def meet(key: tuple, notes: pa.Table, some: pa.Table) -> pa.Table:
        out = []
        if notes.num_rows and some.num_rows:
            matrix = matrix_of(some.column("vec").combine_chunks(), some.num_rows)
            rows = notes.select(["id", "vec"]).to_batches()
            out = list(bank_batches(iter(rows), some.column("id").to_numpy(), matrix, itself))
        return pa.Table.from_batches(out, pa.schema([("note_id", pa.int64()), ("best", pa.float64())]))

    return own.groupBy("shard", "block").cogroup(bank.groupBy("shard", "block")).applyInArrow(meet, "note_id long, best double")


def semantic(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = 0.5, scope: DataFrame | None = None, exclude: DataFrame | None = None, floor: float | None = None) -> DataFrame:
    """(query_id, note_id, score, rank). The score is rounded before ``threshold`` (at least) or ``floor`` (above) judge it."""
    out = nearest(queries, vectors, k, scope, exclude).withColumn("score", round3("sim"))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    if floor is not None:
        out = out.where(F.col("score") > floor)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).select("query_id", "note_id", "score", "rank")


def best_query_cosine(rankings: DataFrame) -> DataFrame:
    """(query_id, best): the greatest similarity over the modalities' first hits; of rows (query_id, modality, sim, rank)."""
    return rankings.where("rank = 1").groupBy("query_id").agg(F.max("sim").alias("best"))


def dot_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, note_id, dot) for (query_id, note_id) pairs with vec, by each note's first vector (least item)."""
    from cardloom.functions.vectors import inner_product

    first = vectors.groupBy("note_id").agg(F.min_by("vec", "item").alias("own"))
    return queries.join(first, "note_id").select("query_id", "note_id", inner_product("vec", "own").alias("dot"))


def anchors(anchor_ids: DataFrame, vectors: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """Notes near given notes (column note_id): semantic search by the anchor's first vector, the anchor itself left out."""
    first = vectors.groupBy("note_id").agg(F.min_by("vec", "item").alias("vec"))
    bank = anchor_ids.select("note_id").join(first, "note_id").select(F.col("note_id").alias("query_id"), "vec")
    return semantic(bank, vectors, k, threshold, exclude=bank.select("query_id", F.col("query_id").alias("note_id")))
