"""Each query's best notes by the number of its terms that their segments hold, for banks and tables of any size.

Segments are dealt to shards and queries to blocks; every block meets every shard in a task of its own. A task gets its queries
first and then its segments, sorted by note and streamed, so it holds some segments at a time however many its shard has. Terms
become rows of a table of bits, segments its columns; a query's overlaps are added up in planes of bits, 64 segments at a time,
and only those above its bar are looked at. As notes come in order, a query that has its notes asks for greater overlaps alone.

The notes of the least ids meet the queries first. What they give is a bar for all later shards, which answer with greater
overlaps only, so what is shuffled is segments times blocks and few rows of a shard; no row is made per query and segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.text import decoded
from cardloom.sources.files import checkpoint

#: Postings of a shard and queries of a block, about; shards that a table of some size has at least, and their least postings.
SHARD_POSTINGS, BLOCK_QUERIES, LEAST_SHARDS, LEAST_POSTINGS = 1 << 24, 1 << 18, 16, 1 << 18
#: The part of the notes that meets the queries first, and the blocks of queries that it does so in at least.
EARLY, EARLY_BLOCKS = 1 / 16, 12
#: Segments of a table of bits at most and at first, and queries that are added up at a time.
WIDTH, FIRST_WIDTH, STEP = 16384, 1024, 64
#: Bytes of a table, and characters that are decoded at a time.
TABLE_BYTES, DECODED = 1 << 24, 1 << 19


def best_overlaps(asked: DataFrame, held: DataFrame, queries: int, postings: int, early: DataFrame | None = None) -> DataFrame:
    """(query_id, note_id, seg_id, overlap): each query's best notes by their best segment; ``most`` of them and some more.

    ``asked``: query_id, held (its terms, three characters each, one after the other; or their numbers, ``coded``), size (how
    many), floor (the least overlap), most. ``held``: seg_id, note_id, held. Of a note the segment of the greatest overlap,
    then of the least id, counts; of notes with equal overlaps the least. ``queries`` and ``postings`` say how many there are,
    about. ``early`` are further segments, whose notes come before all notes of ``held``.
    """
    shards = max(1, min(LEAST_SHARDS, postings // LEAST_POSTINGS), -(-postings // SHARD_POSTINGS))
    blocks = max(1, -(-queries // BLOCK_QUERIES))
    if early is None:
        return _best_rows(_met(asked, held, shards, blocks))
    first = checkpoint(_best_rows(_met(asked, early, max(1, round(shards * EARLY)), max(blocks, EARLY_BLOCKS))))
    bars = first.join(asked.select("query_id", "most"), "query_id").groupBy("query_id", "most").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("overlap"), False).alias("all"))
    bars = bars.where("n >= most and most > 0").select("query_id", F.expr("element_at(all, cast(most as int))").alias("bar"))
    later = asked.join(bars, "query_id", "left").withColumn("floor", F.greatest("floor", F.coalesce(F.col("bar") + 1, F.lit(0))))
    return _best_rows(first.unionByName(_met(later.where("floor <= size"), held, shards, blocks)))


def _best_rows(rows: DataFrame) -> DataFrame:
    """Of a query's rows of one note the best alone."""
    own = Window.partitionBy("query_id", "note_id").orderBy(F.desc("overlap"), "seg_id")
    return rows.repartition("query_id").withColumn("at", F.row_number().over(own)).where("at = 1").drop("at")


def _met(asked: DataFrame, held: DataFrame, shards: int, blocks: int) -> DataFrame:
    """(query_id, note_id, seg_id, overlap): of each shard, each query's best notes."""
    place = lambda of, c: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    kind = dict(asked.dtypes)["query_id"]
    none = lambda of: F.lit(None).cast(of)
    bank = asked.select(F.col("query_id"), none("long").alias("note_id"), none("long").alias("seg_id"), "held", F.col("floor").cast("long"), F.col("most").cast("long"), place(blocks, "query_id").alias("block"), every(shards).alias("shard"))
    own = held.where("note_id is not null and seg_id is not null").select(none(kind).alias("query_id"), F.col("note_id").cast("long"), F.col("seg_id").cast("long"), "held", none("long").alias("floor"), none("long").alias("most"), every(blocks).alias("block"), place(shards, "seg_id").alias("shard"))
    both = bank.unionByName(own).withColumn("task", F.col("shard") * blocks + F.col("block")).drop("shard", "block")
    dealt = both.repartitionById(shards * blocks, F.col("task")).drop("task").sortWithinPartitions(F.asc_nulls_first("note_id"), "seg_id")
    return dealt.mapInArrow(_meet, f"query_id {kind}, note_id long, seg_id long, overlap long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a note are the queries and come first."""
    bank, meeting = [], None
    for batch in batches:
        asked = batch.column("note_id").null_count
        if asked:
            bank.append(batch.slice(0, asked))
        if asked < batch.num_rows and bank:
            if meeting is None:
                meeting = Meeting(*_columns(bank, "held", "floor", "most"))
            for low in range(asked, batch.num_rows, 1024):
                meeting.add(*_columns([batch.slice(low, 1024)], "note_id", "seg_id", "held"))
    if meeting is not None:
        queries = pa.chunked_array([b.column("query_id") for b in bank]).combine_chunks()
        for at, note, seg, overlap in meeting.best():
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(at)), pa.array(note), pa.array(seg), pa.array(overlap)], names=["query_id", "note_id", "seg_id", "overlap"])


def _columns(batches: list[pa.RecordBatch], *names: str) -> list[list]:
    return [[x for b in batches for x in b.column(n).to_pylist()] for n in names]


def _codes(held: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the string, number of the term) for strings of terms of three characters, or for ``coded`` numbers."""
    if isinstance(held[0], bytes):
        return decoded(held)
    of = np.repeat(np.arange(len(held)), np.array([len(x) // 3 for x in held], dtype=np.int64))
    three = np.frombuffer("".join(held).encode("utf-32-le"), dtype=np.uint32).reshape(-1, 3).astype(np.int64)
    return of, three[:, 0] << 42 | three[:, 1] << 21 | three[:, 2]


def _planes(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of bits, column by column, as planes of bits from the least."""
    planes = []
    while rows:
        carried = []
        while len(rows) > 2:
            a, b, c, *rows = rows
            one = a ^ b
            carried.append(a & b | one & c)
            rows.append(one ^ c)
        if len(rows) == 2:
            carried.append(rows[0] & rows[1])
            rows = [rows[0] ^ rows[1]]
        planes.append(rows[0])
        rows = carried
    return planes


def _above(planes: list[np.ndarray], bar: np.ndarray) -> np.ndarray:
    """Where sums are above their row's bar: what is carried beyond the last plane when as much is added as the bar leaves."""
    rest, carried = (1 << len(planes)) - 1 - bar, None
    for i, plane in enumerate(planes):
        bit = (-(rest >> i & 1)).astype(np.int64).view(np.uint64)[:, None]
        carried = plane & bit if carried is None else plane & carried | bit & (plane | carried)
    return carried


class Meeting:
    """Queries that segments are added to, in the order of their notes and ids."""

    def __init__(self, asked: list[str] | list[bytes], floor: list[int], most: list[int]):
        of, codes = _codes(asked)
        self.terms, codes = np.unique(codes, return_inverse=True)
        self.places = None
        if isinstance(asked[0], bytes):  # small numbers; all beyond the last have the place after it
            self.places = np.full(int(self.terms[-1]) + 2, len(self.terms), dtype=np.int32)
            self.places[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        self.size = np.bincount(of, minlength=len(asked))
        self.rows = np.full((len(asked), max(1, int(self.size.max()))), len(self.terms), dtype=np.int32)  # the table's last row has no segment
        self.rows[of, np.arange(len(of)) - np.searchsorted(of, of)] = codes
        self.most = np.array(most, dtype=np.int64)
        self.least = np.array(floor, dtype=np.int64) - 1
        self.bar = np.where(self.most > 0, self.least, self.size)
        words = max(1, TABLE_BYTES // 8 // (len(self.terms) + 1))
        self.width, self.widest = (64 * min(-(-w // 64), words) for w in (min(FIRST_WIDTH, WIDTH), WIDTH))
        self.step = 64 * max(1, min(32, words // 8))
        steps = range(0, len(asked), STEP)
        self.kept, self.new = [(np.zeros(0, dtype=np.int64),) * 4 for _ in steps], [[] for _ in steps]
        self.note, self.seg, self.held, self.column, self.last = [], [], [], [], None

    def add(self, note: list[int], seg: list[int], held: list[str] | list[bytes]) -> None:
        for n, s, own in zip(note, seg, held, strict=True):
            if (n, s) != self.last:  # rows of one segment are one column
                if len(self.note) == self.width:
                    self._ask()
                self.last = n, s
                self.note.append(n)
                self.seg.append(s)
            self.held.append(own)
            self.column.append(len(self.note) - 1)

    def best(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the query, note, segment, overlap) of each query's best notes, some queries at a time."""
        self._ask()
        for low in range(0, len(self.kept), 256):
            for i in range(low, min(low + 256, len(self.kept))):
                self._settle(i)
            rows = [np.concatenate(x) for x in zip(*self.kept[low : low + 256], strict=True)]
            if len(rows[0]):
                yield tuple(rows)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """The terms' rows; of those that no query has, the row that has no segment."""
        if self.places is not None:
            return self.places[np.minimum(codes, len(self.places) - 1)]
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        return np.where(self.terms[at] == codes, at, len(self.terms))

    def _table(self) -> np.ndarray:
        """Bits of terms by segments."""
        n, column, ends = len(self.note), np.array(self.column, dtype=np.int64), np.cumsum([len(x) for x in self.held])
        table = np.zeros((len(self.terms) + 1, -(-n // 64)), dtype=np.uint64)
        for low in range(0, n, self.step):
            high = min(low + self.step, n)
            flags = np.zeros((len(table), 64 * -(-(high - low) // 64)), dtype=np.uint8)
            begin, last = np.searchsorted(column, [low, high])
            while begin < last:
                end = min(last, max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + DECODED))))
                of, codes = _codes(self.held[begin:end])
                flags[self._places(codes), column[begin + of] - low] = 1
                begin = end
            flags[-1] = 0
            words = np.packbits(flags, axis=1, bitorder="little").view("<u8")
            table[:, low // 64 : low // 64 + words.shape[1]] = words
        return table

    def _ask(self) -> None:
        if self.note:
            table, note, seg = self._table(), np.array(self.note, dtype=np.int64), np.array(self.seg, dtype=np.int64)
            for i, first in enumerate(range(0, len(self.rows), STEP)):
                own = first + np.flatnonzero(self.bar[first : first + STEP] < self.size[first : first + STEP])
                if len(own):
                    planes = _planes([table[r] for r in self.rows[own].T])
                    above = _above(planes, self.bar[own])
                    words = np.flatnonzero(above)
                    if len(words):
                        which, bit = np.nonzero(np.unpackbits(above.ravel()[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                        words = words[which]
                        n = sum((p.ravel()[words] >> bit.astype(np.uint64) & np.uint64(1)).astype(np.int64) << k for k, p in enumerate(planes))
                        q, word = np.divmod(words, table.shape[1])
                        at = 64 * word + bit
                        self.new[i].append((own[q], note[at], seg[at], n))
                        if sum(len(x[0]) for x in self.new[i]) > len(self.kept[i][0]) // 2:
                            self._settle(i)
        self.note, self.seg, self.held, self.column = [], [], [], []
        self.width = min(2 * self.width, self.widest)

    def _settle(self, i: int) -> None:
        """Each query's best rows, a note's best alone, by overlap and then by note; and the bars that follow."""
        if not self.new[i]:
            return
        at, note, seg, n = (np.concatenate(x) for x in zip(self.kept[i], *self.new[i], strict=True))
        order = np.lexsort((seg, -n, note, at))
        at, note, seg, n = at[order], note[order], seg[order], n[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (at[1:] != at[:-1]) | (note[1:] != note[:-1])
        at, note, seg, n = at[first], note[first], seg[first], n[first]
        order = np.lexsort((note, -n, at))
        order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < self.most[at[order]]]
        at, note, seg, n = self.kept[i] = at[order], note[order], seg[order], n[order]
        self.new[i] = []
        last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
        full = last[np.diff(np.append(-1, last)) >= self.most[at[last]]]
        self.bar[at[full]] = np.maximum(n[full], self.least[at[full]])
