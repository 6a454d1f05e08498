"""Exact nearest notes for a bank that is a table of any size.

Vectors are dealt to cells around pivots, and each cell knows its radius. A query first asks the cells whose pivots are most
like it, enough of them to hold its k notes; the k-th similarity that it finds there is its bar. For a cell's vectors v around
the pivot p no product exceeds q·p + |q| · radius, so only cells that can pass the bar are asked as well. No query passes
the driver; what does are the pivots and one row per cell, at most MOST_PIVOTS of each.

Cells and questions meet in tasks of bounded size: a cell of many vectors is cut in blocks, and of many questions in
chunks. Products are estimated by matrices and the candidates' taken again in the components' order, as expressions add them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.sources.files import checkpoint

MOST_PIVOTS = 1024
#: Vectors of a block, questions of a chunk, and questions that are multiplied at a time.
BLOCK_VECTORS, CHUNK_QUERIES, STEP = 8192, 65_536, 128
#: Questions to cells that a task makes at a time.
ASKED = 1 << 16


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def exact_products(vectors: np.ndarray, queries: np.ndarray, of_vector: np.ndarray, of_query: np.ndarray) -> np.ndarray:
    """Inner products of pairs, terms added in the components' order."""
    out = np.zeros(len(of_vector))
    for at in range(vectors.shape[1]):
        out += vectors[of_vector, at] * queries[of_query, at]
    return out


def best_pairs(notes: np.ndarray, vectors: np.ndarray, queries: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, note, product): each query's ``keep`` best notes, each by its best vector; ties to smaller ids."""
    places, found = [], []
    reach = np.sqrt((vectors * vectors).sum(axis=1)).max(initial=0.0)
    several = len(np.unique(notes)) < len(notes)
    for low in range(0, len(queries), STEP):
        part, few = queries[low : low + STEP], keep[low : low + STEP]
        estimates = part @ vectors.T
        slack = 1e-12 * len(vectors[0]) * (1 + reach * np.sqrt((part * part).sum(axis=1)))
        for i, most in enumerate(few.tolist()):
            row = estimates[i]
            floor = -np.inf
            for wanted in ((4 * most, 64 * most) if several else (most,)):
                if wanted >= len(row):
                    floor = -np.inf
                    break
                floor = np.partition(row, len(row) - wanted)[len(row) - wanted] - 2 * slack[i]
                if not several or len(np.unique(notes[row >= floor])) >= most:
                    break
                floor = -np.inf
            some = np.flatnonzero(row >= floor)
            places.append(np.full(len(some), low + i))
            found.append(some)
    none = np.zeros(0, dtype=np.int64)
    at, rows = np.concatenate([*places, none]), np.concatenate([*found, none])
    sims, ids = exact_products(vectors, queries, rows, at), notes[rows]
    order = np.lexsort((ids, -sims, at))
    at, ids, sims = at[order], ids[order], sims[order]
    if several:
        by_note = np.lexsort((np.arange(len(at)), ids, at))
        first = np.ones(len(at), dtype=bool)
        first[1:] = (at[by_note][1:] != at[by_note][:-1]) | (ids[by_note][1:] != ids[by_note][:-1])
        held = np.sort(by_note[first])
        at, ids, sims = at[held], ids[held], sims[held]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    held = rank < keep[at]
    return at[held], ids[held], sims[held]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (cell, block, chunk, asks, id, vec, keep, level), sorted: of each group its vectors, then its questions."""
    group, notes, held, vectors, known = None, [], [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            *key, asks = keys[low]
            part = batch.slice(low, high - low)
            ids, matrix = part.column(4).to_numpy(), matrix_of(part.column(5), high - low)
            if key != group:
                group, notes, held, vectors = key, [], [], None
            if not asks:
                notes.append(ids)
                held.append(matrix)
                continue
            if vectors is None and held:
                vectors, known = np.concatenate(held), np.concatenate(notes)
                held, notes = [], []
            if vectors is not None:
                at, found, sims = best_pairs(known, vectors, matrix, part.column(6).to_numpy())
                level = part.column(7).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(sims), pa.array(level[at])], names=["query_id", "note_id", "sim", "level"])


def block_best(vectors: DataFrame, asks: DataFrame) -> DataFrame:
    """(query_id, note_id, sim, level): of each block of each asked cell the question's ``keep`` best notes.

    ``vectors``: cell, note_id, vec; ``asks``: cell, query_id, vec, keep, level (given back).
    """
    sizes = vectors.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    sizes = sizes.join(asks.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks")), "cell")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    vec = F.col("vec").cast("array<double>").alias("vec")
    own = vectors.join(sizes, "cell").select("cell", of("note_id", "blocks").alias("block"), spread("chunks").alias("chunk"), F.lit(False).alias("asks"), F.col("note_id").cast("long").alias("id"), vec, F.lit(0).alias("keep"), F.lit(0).alias("level"))
    questions = asks.join(sizes, "cell").select("cell", spread("blocks").alias("block"), of("query_id", "chunks").alias("chunk"), F.lit(True).alias("asks"), F.col("query_id").cast("long").alias("id"), vec, F.col("keep").cast("int"), F.col("level").cast("int"))
    keys = ["cell", "block", "chunk"]
    return own.unionByName(questions).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(_meet, "query_id long, note_id long, sim double, level int")


class Cells:
    """Vectors (note_id, vec) dealt to cells around pivots: ``table`` has cell, note_id, vec."""

    def __init__(self, vectors: DataFrame, most: int = MOST_PIVOTS):
        plain = vectors.select("note_id", "vec").where("vec is not null")
        n = plain.count()
        wanted = min(most, max(1, int(n**0.5)))
        chosen = plain.orderBy(F.xxhash64("note_id"), "note_id", "vec").limit(wanted).select("vec").collect()
        self.pivots = pivots = np.array([r.vec for r in chosen], dtype=np.float64)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    matrix = matrix_of(batch.column(1), batch.num_rows)
                    cell = np.argmax(matrix @ pivots.T - (pivots * pivots).sum(axis=1) / 2, axis=1)
                    gap = np.sqrt(((matrix - pivots[cell]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(str)), batch.column(0), batch.column(1), pa.array(gap)], names=["cell", "note_id", "vec", "gap"])

        kinds = dict(plain.dtypes)
        self.table = checkpoint(plain.mapInArrow(place, f"cell string, note_id {kinds['note_id']}, vec {kinds['vec']}, gap double")) if n else None
        self.counts, self.radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
        for r in self.table.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("far")).collect() if n else []:
            self.counts[int(r.cell)], self.radius[int(r.cell)] = r.n, r.far

    def asks(self, queries: DataFrame, again: bool) -> DataFrame:
        """The cells that each query asks: at first those most like it that hold 4 * keep vectors; then, by its ``bar``, the
        others that can pass it. ``queries``: query_id, vec, keep and, with ``again``, bar."""
        pivots, counts, radius = self.pivots, self.counts, self.radius

        step = max(1, ASKED // max(1, len(pivots)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(low, step) for b in batches for low in range(0, b.num_rows, step)):
                matrix, keep = matrix_of(batch.column(1), batch.num_rows), batch.column(2).to_numpy()
                like = matrix @ pivots.T
                order = np.argsort(-like, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                asked = np.zeros(like.shape, dtype=bool)
                np.put_along_axis(asked, order, before < 4 * keep[:, None], axis=1)
                if again:
                    length = np.sqrt((matrix * matrix).sum(axis=1))
                    most = like + length[:, None] * radius
                    bar = batch.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    slack = 1e-9 * (1 + np.abs(most).max(axis=1))
                    asked = ~asked & (most >= (bar - slack)[:, None])
                at, cell = np.nonzero(asked & (counts > 0))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(str), pa.string()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(keep[at]), pa.array(np.zeros(len(at), dtype=np.int32))], names=["cell", "query_id", "vec", "keep", "level"])

        return queries.mapInArrow(run, "cell string, query_id long, vec array<double>, keep int, level int")


def nearest_dealt(queries: DataFrame, vectors: DataFrame, k: int, exclude: DataFrame | None = None, cells: Cells | None = None, asked: list | None = None) -> DataFrame:
    """(query_id, note_id, sim): at least each query's k best notes, without those that ``exclude`` (query_id, note_id) names.

    ``queries``: query_id, vec; several vectors of a query count as one question, answered by the best of them. ``asked``
    gets the two tables of questions, from which ``pairs_scored`` tells the share of all pairs that was multiplied.
    """
    spark = queries.sparkSession
    cells = cells or Cells(vectors)
    if cells.table is None or k <= 0:
        return spark.createDataFrame([], "query_id long, note_id long, sim double")
    bank = queries.select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    keep = F.lit(k)
    if exclude is not None:
        bank = bank.join(exclude.groupBy("query_id").agg(F.count("*").alias("extra")), "query_id", "left")
        keep = keep + F.coalesce("extra", F.lit(0))
    bank = bank.select("query_id", "vec", keep.cast("int").alias("keep"))
    first = cells.asks(bank, False)
    found = checkpoint(block_best(cells.table, first))
    best = found.groupBy("query_id", "note_id").agg(F.max("sim").alias("sim"))
    ranked = best.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"))))
    bars = ranked.join(bank.select("query_id", "keep").distinct(), "query_id").where("at = keep").select("query_id", F.col("sim").alias("bar"))
    rest = cells.asks(bank.join(bars, "query_id", "left").select("query_id", "vec", "keep", "bar"), True)
    if asked is not None:
        asked += [first, rest]
    every = found.unionByName(block_best(cells.table, rest)).select("query_id", "note_id", "sim")
    return every if exclude is None else every.join(exclude.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")


def pairs_scored(cells: Cells, asked: list[DataFrame], n_queries: int) -> float:
    """The share of all pairs of queries and vectors that a search multiplied."""
    counts = cells.table.groupBy("cell").count()
    scored = sum((a.join(counts, "cell").agg(F.sum("count")).first()[0] or 0) for a in asked)
    return scored / max(1, n_queries * int(cells.counts.sum()))
