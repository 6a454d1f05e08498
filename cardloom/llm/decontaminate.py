"""Benchmark decontamination by SimHash windows in a multi-index, verified by exact similarity (operator 6).

Benchmark items are compiled once per worker. Items of one length are a family: their SimHash fingerprints stand in a
multi-index, 8 blocks of 8 bits. Fingerprints within 23 bits agree in some block up to 2 bits, so the blocks' tables, which
list items under every value that near, propose all items within the radius; a popcount confirms them.

A document is streamed once. Its windows of the family's length are fingerprinted where they hold so many of the benchmark's
shingles that the similarity can be reached at all. The items that the index proposes for a window are verified by the exact
weighted similarity (sum of least weights over sum of greatest), 0.8 or more, from counts that slide with the window.

Fingerprints are of the shingles that the benchmark knows, as others can be in no item: text around a passage, however it
repeats, doesn't move them. A window that repeats shingles is also looked up by each of them once, so that neither many
repeats nor many others hide what it shares.

The benchmark goes to workers with the code, in slices of checked size; the driver holds one slice at a time.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import checkpoint, in_slices

#: Words of a shingle, least similarity, and greatest Hamming distance of fingerprints.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Blocks of a fingerprint, which share the radius, and bits of a block.
BLOCKS, BITS = 8, 8
#: Windows that are fingerprinted at a time.
WINDOWS = 8_192
#: UTF-8 bytes of items that one pass over the documents carries.
SLICE_BYTES = 4_000_000
_UNKNOWN = 0x5851F42D4C957F2D
_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores, so that case and punctuation hide nothing."""
    return _WORDS.findall((text or "").lower())


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two shingle counts."""
    low = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def _votes(grams: np.ndarray) -> np.ndarray:
    """For each hash its 64 bits as 1 or -1."""
    return 2 * np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) - 1


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1).reshape(-1).view(">u8").astype(np.uint64)


class MultiIndex:
    """Fingerprints by blocks: all of those within the radius of a given one."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        values = np.arange(1 << BITS, dtype=np.uint64)[:, None]
        self.tables = [np.bitwise_count(values ^ self._block(prints, b)[None, :]) <= radius // BLOCKS for b in range(BLOCKS)]

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return prints >> np.uint64(block * BITS) & np.uint64((1 << BITS) - 1)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in asked, position in prints) within the radius, by position in asked."""
        asks, found, some = [], [], max(1, 4_000_000 // max(1, len(self.prints)))
        for at in range(0, len(asked), some):
            part = asked[at : at + some]
            proposed = self.tables[0][self._block(part, 0).astype(np.intp)].copy()
            for b in range(1, BLOCKS):
                proposed |= self.tables[b][self._block(part, b).astype(np.intp)]
            a, i = np.nonzero(proposed)
            close = np.bitwise_count(part[a] ^ self.prints[i]) <= self.radius
            asks.append(a[close] + at)
            found.append(i[close])
        return (np.concatenate(asks), np.concatenate(found)) if asks else (np.zeros(0, np.intp), np.zeros(0, np.intp))


class Family:
    """Items of one number of words: their numbers, and the indexes of their fingerprints by weight and by presence."""

    def __init__(self, members: list[int], grams: list[tuple[np.ndarray, np.ndarray]], per: int, radius: int):
        self.members, self.per = members, per
        by_weight = _fingerprints(np.array([(_votes(g) * n[:, None]).sum(axis=0) for g, n in grams]))
        by_presence = _fingerprints(np.array([_votes(g).sum(axis=0) for g, _ in grams]))
        self.weighted, self.present = MultiIndex(by_weight, radius), MultiIndex(by_presence, radius)


class Items:
    """The compiled benchmark."""

    def __init__(self, rows: list[tuple[int, str | None]], size: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        from xxhash import xxh64_intdigest

        self.size, self.least = size, least
        kept = [(i, w) for i, t in rows if (w := words_of(t))]
        #: Words that no item has are one word, as none of their shingles is looked at.
        self.number = {w: xxh64_intdigest(w.encode()) for _, ws in kept for w in ws}
        self.ids = [i for i, _ in kept]
        self.lengths = np.array([len(w) for _, w in kept], dtype=np.int64)
        widths = np.minimum(self.lengths, size)  # an item of fewer words than a shingle is one shingle
        self.grams = [np.unique(self._shingles(self._hashes(w), int(k)), return_counts=True) for (_, w), k in zip(kept, widths, strict=True)]
        self.weights: dict[int, dict[int, int]] = {}  # of items that have been proposed
        of: dict[tuple[int, int], list[int]] = defaultdict(list)
        for at, (length, width) in enumerate(zip(self.lengths.tolist(), widths.tolist(), strict=True)):
            of[width, length].append(at)
        self.families: dict[int, list[Family]] = defaultdict(list)
        for (width, length), members in sorted(of.items()):
            self.families[width].append(Family(members, [self.grams[i] for i in members], length - width + 1, radius))
        self.known = {w: np.unique(np.concatenate([self.grams[i][0] for f in fs for i in f.members])) for w, fs in self.families.items()}

    def _hashes(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, _UNKNOWN) for w in words], dtype=np.uint64)

    @staticmethod
    def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = hashes[:n].copy()
        with np.errstate(over="ignore"):
            for k in range(1, size):
                out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
                out ^= out >> np.uint64(29)
            return out * np.uint64(0xBF58476D1CE4E5B9)

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window, the first of the best, for each item that the text holds."""
        words = words_of(text)
        if not words:
            return []
        hashes = self._hashes(words)
        best: dict[int, tuple[float, int]] = {}
        for width, families in self.families.items():
            grams, keys = self._shingles(hashes, width), self.known[width]
            if not len(grams):
                continue
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            at = np.flatnonzero(keys[place] == grams)
            for family in families:  # shorter items first
                if len(at) < self._need(family.per):
                    break
                for starts in self._windows(at, family.per, len(grams)):
                    self._judge(family, grams, at, starts, best)
        return [(self.ids[i], s, at, int(min(self.lengths[i], len(words) - at))) for i, (s, at) in sorted(best.items())]

    def _need(self, per: int) -> int:
        """Known shingles without which a window of ``per`` can't be similar enough."""
        return max(1, ceil(self.least * per - 1e-9))

    def _windows(self, at: np.ndarray, per: int, n: int) -> Iterator[np.ndarray]:
        """Starts of windows of ``per`` shingles that hold enough known ones, which stand ``at`` these places, in pieces.

        A similarity s takes at least s shared of what an item has. Places further apart than a window are looked at apart.
        """
        need = self._need(per)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) >= per) + 1, [len(at)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if j - i < need:
                continue
            low, high = max(0, int(at[i]) - per + 1), min(max(0, n - per), int(at[j - 1]))
            for first in range(low, high + 1, WINDOWS):
                starts = np.arange(first, min(first + WINDOWS, high + 1))
                starts = starts[np.searchsorted(at, starts + per) - np.searchsorted(at, starts) >= need]
                if len(starts):
                    yield starts

    def _judge(self, family: Family, grams: np.ndarray, at: np.ndarray, starts: np.ndarray, best: dict[int, tuple[float, int]]) -> None:
        """Look the windows up, and verify what is proposed."""
        i, j = np.searchsorted(at, [starts[0], starts[-1] + family.per])
        places, held = at[i:j], grams[at[i:j]]
        low, high = np.searchsorted(places, starts), np.searchsorted(places, starts + family.per)
        sums = np.zeros((len(held) + 1, 64), dtype=np.int32)
        np.cumsum(_votes(held), axis=0, out=sums[1:])
        asked, found = family.weighted.near(_fingerprints(sums[high] - sums[low]))
        proposed = {int(k): set(starts[asked[found == k]].tolist()) for k in np.unique(found)}
        # windows that repeat a shingle by presence as well
        order = np.argsort(held, kind="stable")
        back = np.full(len(held), -1)
        again = held[order][1:] == held[order][:-1]
        back[order[1:][again]] = order[:-1][again]
        repeats = np.flatnonzero(np.maximum.accumulate(back)[high - 1] >= low)
        if len(repeats):
            prints = _fingerprints(np.array([_votes(np.unique(held[low[r] : high[r]])).sum(axis=0) for r in repeats.tolist()]))
            asked, found = family.present.near(prints)
            for k in np.unique(found):
                proposed.setdefault(int(k), set()).update(starts[repeats[asked[found == k]]].tolist())
        for k, where in sorted(proposed.items()):
            item = family.members[k]
            if item not in best or best[item][0] < 1.0:
                verified = self._verify(item, family.per, grams, sorted(where))
                if verified and (item not in best or verified[0] > best[item][0]):
                    best[item] = verified

    def _verify(self, item: int, per: int, grams: np.ndarray, starts: list[int]) -> tuple[float, int] | None:
        """The greatest exact similarity of the windows, and its first start, if it is enough."""
        if item not in self.weights:
            self.weights[item] = dict(zip(*(x.tolist() for x in self.grams[item]), strict=True))
        own, best = self.weights[item], None
        offset = starts[0]
        part = grams[offset : starts[-1] + per].tolist()
        counts: dict[int, int] = defaultdict(int)
        low = begin = end = 0  # low: the sum of least weights over part[begin:end]
        for start in (s - offset for s in starts):
            if start >= end:
                counts.clear()
                low, begin, end = 0, start, start
            stop = min(start + per, len(part))
            for g in part[end:stop]:
                if g in own:
                    counts[g] += 1
                    low += counts[g] <= own[g]
            for g in part[begin:start]:
                if g in own:
                    low -= counts[g] <= own[g]
                    counts[g] -= 1
            begin, end = start, stop
            s = low / (per + stop - start - low)
            if s >= self.least and (best is None or s > best[0]):
                best = (s, start + offset)
                if s == 1.0:
                    break
        return best


#: The last compiled slices of this worker, by name.
_COMPILED: dict[str, Items] = {}


def compiled(name: str, rows: list[tuple[int, str | None]], size: int, least: float) -> Items:
    """The slice's items, compiled once for all tasks of a worker."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = Items(rows, size, least)
    return _COMPILED[name]


#: Stand for the verdict, what was found and a row's number beside any columns that documents have.
_FLAG, _HELD, _ROW = "_cardloom_contaminated", "_cardloom_items", "_cardloom_row"
_KIND = "array<struct<item_id:bigint,similarity:double,word_from:int,words:int>>"


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", keep: str = "report") -> DataFrame:
    """One row per document: doc_id, contaminated, and items, an array of (item_id, similarity, word_from, words).

    With ``keep="clean"``: the documents, all columns, that hold no item. Null and empty texts hold no item; null, wordless
    and repeated items find nothing more than others. Null ids and repeated rows keep their rows. Documents of any length are
    read whole, in pieces of WINDOWS windows. A benchmark beyond SLICE_BYTES of text goes in slices, each a pass over the
    numbered documents.
    """
    report = docs if keep == "clean" else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    at = report.columns.index(text_col if keep == "clean" else "text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("word_from", pa.int32()), ("words", pa.int32())]))

    def one(frame: DataFrame, rows: list[tuple[int, str | None]]) -> DataFrame:
        schema, name = T.StructType([*frame.schema.fields, *T.StructType.fromDDL(f"{_HELD} {_KIND}").fields]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = compiled(name, rows, size, least)
            for batch in in_slices(batches):
                found = [[dict(zip(("item_id", "similarity", "word_from", "words"), f, strict=True)) for f in items.search(t)] for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.names)

        return frame.mapInArrow(run, schema)

    slices = benchmark_slices(benchmark)
    rows, following = next(slices, []), next(slices, None)
    if following is None:
        found = one(report, rows)
    else:
        numbered = checkpoint(report.withColumn(_ROW, F.monotonically_increasing_id()))
        hits = None
        while rows is not None:
            part = checkpoint(one(numbered, rows).where(F.size(_HELD) > 0).select(_ROW, _HELD))
            hits = part if hits is None else hits.unionByName(part)
            rows, following = following, next(slices, None)
        held = hits.groupBy(_ROW).agg(F.array_sort(F.flatten(F.collect_list(_HELD))).alias(_HELD))
        found = numbered.join(held, _ROW, "left").withColumn(_HELD, F.coalesce(_HELD, F.array().cast(_KIND)))
    if keep == "clean":
        return found.where(F.size(_HELD) == 0).select(docs.columns)
    return found.select("doc_id", (F.size(_HELD) > 0).alias("contaminated"), F.col(_HELD).alias("items"))


def benchmark_slices(benchmark: DataFrame, most: int | None = None) -> Iterator[list[tuple[int, str | None]]]:
    """The items in slices of bounded size, one at a time."""
    held, rows = 0, []
    for row in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len((row.text or "").encode())
        if rows and held + n > (most or SLICE_BYTES):
            yield rows
            held, rows = 0, []
        rows.append((row.item_id, row.text))
        held += n
    if rows:
        yield rows
