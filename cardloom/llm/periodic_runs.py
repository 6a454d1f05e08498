"""Periodic runs of words by Karp-Miller-Rosenberg naming (operator 13).

Level k names every block of 2 ** k words: equal blocks of a document get equal names. A level's names are the ranks of
pairs of names of the level below, so names are exact; no hashes are taken and no suffixes are sorted. The longest common
extension of two places follows by descending through the levels.

A run of period p and at least four periods holds a whole grid cell: some multiple i of 2p with the words from i to
i + p + 2 ** k inside the run, where 2 ** k is the greatest power up to p. So equal names of level k at i and i + p
propose all runs of period p, from n / 2p places each, and extensions to both sides decide.

Documents are searched many at a time: words are coded document by document, so that no block of one equals a block
of another, and levels end where no name repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import WORD_RE, give_back

#: Words of documents that are searched together; a longer document is searched alone.
BATCH_WORDS = 200_000
#: Candidates that are extended together.
BATCH_PAIRS = 1_000_000
#: The grid needs runs of at least so many periods.
LEAST_EXPONENT = 4


def name_levels(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """The names of all blocks of 1, 2, 4, ... words, up to ``longest`` words and the last level on which a name repeats."""
    levels, size = [codes], 1
    while 2 * size <= min(longest, len(codes)):
        below = levels[-1]
        pairs = below[:-size].astype(np.int64) * (int(below.max()) + 1) + below[size:]
        values, names = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            break
        levels.append(names.astype(np.int32))
        size *= 2
    return levels


def _extension(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from two places on (or before them) are equal; ``left`` < ``right``."""
    left, right = left.copy(), right.copy()
    start = right.copy()
    top = len(levels) - 1
    for k in range(top, -1, -1):
        names, size = levels[k], 1 << k
        active = np.arange(len(left))
        while len(active):  # below the top level a second round never moves
            a, b = left[active], right[active]
            if not ahead:
                a, b = a - size, b - size
            inside = (b < len(names)) if ahead else (a >= 0)
            active, a, b = active[inside], a[inside], b[inside]
            equal = names[a] == names[b]
            active = active[equal]
            left[active] += size if ahead else -size
            right[active] += size if ahead else -size
            if k < top:
                break
    return np.abs(right - start)


def find_runs(codes: np.ndarray, longest: int, exponent: int = LEAST_EXPONENT, shortest: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period. ``longest``: words of the longest document."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    levels = name_levels(codes, longest)

    def extend(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, p = (np.concatenate(x) for x in zip(*pairs, strict=True))
        start = i - _extension(levels, i, i + p, ahead=False)
        end = i + p + _extension(levels, i, i + p, ahead=True)
        whole = (end - start >= exponent * p) & (end - start >= shortest)
        found.append(np.unique(np.stack([start[whole], end[whole], p[whole]], axis=1), axis=0))

    for k, names in enumerate(levels):
        size, pairs, n = 1 << k, [], 0
        for period in range(size, min(2 * size, longest // exponent + 1)):
            at = np.arange(0, len(names) - period, 2 * period)
            at = at[names[at] == names[at + period]]
            if len(at):
                pairs.append((at, np.full(len(at), period)))
                n += len(at)
            if n >= BATCH_PAIRS:
                extend(pairs)
                pairs, n = [], 0
        if pairs:
            extend(pairs)
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # the same stretch is found with multiples of its period too: the smallest stays
    first = np.ones(len(every), dtype=bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[first]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _search(docs: list[list[str]], exponent: int, shortest: int) -> Iterator[tuple[list[dict], str]]:
    """The runs and the text without repetitions of each document's words."""
    codes, base = [], 0
    for words in docs:
        own = dict.fromkeys(words)
        for i, word in enumerate(own, base):
            own[word] = i
        codes.append(np.fromiter(map(own.__getitem__, words), dtype=np.int32, count=len(words)))
        base += len(own)
    bounds = np.cumsum([0, *map(len, docs)])
    longest = max(map(len, docs), default=0)
    start, end, period = find_runs(np.concatenate(codes), longest, exponent, shortest) if longest else (np.zeros(0, dtype=np.int64),) * 3
    change = np.zeros(bounds[-1] + 1, dtype=np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    stays = np.cumsum(change)[:-1] == 0
    first = np.searchsorted(start, bounds)
    for i, words in enumerate(docs):
        low, high = bounds[i], bounds[i + 1]
        runs = [{"start": s - low, "length": e - s, "period": q} for s, e, q in zip(*(x[first[i] : first[i + 1]].tolist() for x in (start, end, period)), strict=True)]
        keeps = stays[low:high]
        yield runs, " ".join(words if keeps.all() else [w for w, keep in zip(words, keeps.tolist(), strict=True) if keep])


def split(doc_id: int | None, text: str | None) -> list[str]:
    return WORD_RE.findall(text or "")


def planted(doc_id: int | None, text: str | None) -> list[str]:
    """The words of a document, in one of ten (by the CRC-32 of its decimal id) with a repeated passage up to its end.

    A null id has no decimal form, so nothing is planted there.
    """
    words = split(doc_id, text)
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, exponent: int = LEAST_EXPONENT, shortest: int = 6, words_of: Callable[[int | None, str | None], list[str]] = split) -> DataFrame:
    """(doc_id, n_words, runs, text) of each document: its maximal runs and its words without their repetitions.

    A run is a stretch of words with smallest period q, of at least ``exponent`` (4 or more) periods and ``shortest`` words,
    that no neighbour extends. ``runs`` go by start, then period; ``text`` holds the words, joined by one space, that no run
    contains after its first q words. ``words_of`` gives the words of an id and a text. Null and empty texts have no words
    and no runs. Each row is judged alone, so null ids and repeated rows need no rule; other columns aren't read. A text of
    n words is searched whole and takes up to 4 n log2 n bytes, that much only where it repeats itself at every length.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"runs of fewer than {LEAST_EXPONENT} periods may lie beside the grid")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, docs: list[list[str]]) -> pa.RecordBatch:
            runs, texts = zip(*_search(docs, exponent, shortest), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, docs), pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "text"])

        for batch in batches:
            ids, docs, held = [], [], 0
            for at in range(batch.num_rows):
                doc_id = batch.column(0)[at].as_py()
                words = words_of(doc_id, batch.column(1)[at].as_py())
                if docs and held + len(words) > BATCH_WORDS:
                    yield done(ids, docs)
                    ids, docs, held = [], [], 0
                ids.append(doc_id)
                docs.append(words)
                held += len(words)
            if docs:
                yield done(ids, docs)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, text string")


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the run with the greatest exponent (ties: the smallest start, then period), and
    SHA-256 of all runs and of the text."""
    better = lambda best, x: F.when(best["period"].isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast(RUN), better)
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
