"""Removal of passages that repeat across documents, by repeated-phrase automata (operator 7).

A window is ``width`` consecutive words. The least hash of its phrases of GRAM words is its anchor, so equal windows have
equal anchors wherever they stand. A run of windows with one anchor makes a *piece* of a document, a few words longer than a
window; a document's pieces hold all of its windows.

1. Documents are dealt in chunks of bounded size. Each sends how many different pieces it has of each anchor, and is told
   which anchors others have as well. What isn't shared can't recur and goes no further.
2. Pieces of shared anchors go to the shard of their anchor, once per chunk, with their least document.
3. A shard takes pieces that are alike as one, confirms which windows recur among the others, word by word, and compiles them
   into Aho-Corasick automata (words as symbols). All pieces, from all documents, are streamed through: a match tells which window stands where, and so the
   least document of each window. Pieces with a window that an earlier document has are answered.
4. Chunks remove the words that such windows cover.

Everything is sent once per chunk, so an exact copy held by a third of all documents costs each chunk one entry per piece.
An anchor of very many pieces (a common phrase, each time among other words) is dealt out window by window, by the window's
own hash. Hashes place windows only; that two are equal is told by their words, within a chunk by exact names of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from cardloom.llm.common import WORD_RE_BYTES, give_back, sorted_groups

#: UTF-8 bytes of a chunk's documents, on average.
CHUNK_BYTES = 3_000_000
#: Chunks that share a task, on average.
CHUNKS_PER_PARTITION = 4
#: Bytes of documents for each bucket of anchors, and for each shard of pieces.
BUCKET_BYTES, SHARD_BYTES = 24_000_000, 6_000_000
#: Words of an anchor, and pieces of an anchor beyond which its windows are dealt out one by one.
GRAM, HOT = 4, 20_000
#: Windows of an automaton.
AUTOMATON = 30_000
_LAST = np.iinfo(np.int64).max


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Odd bases of the running sums.
_BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a text that ends with white space, and the byte after it."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, dtype=np.uint8)]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_names(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers for each word that only equal words share, and a 64-bit hash.

    Up to 15 bytes, the numbers are the bytes themselves and their count; a longer word's is its place among those of the text.
    """
    eight = np.ndarray((len(raw) + 9,), dtype="<u8", buffer=raw + bytes(16), strides=(1,))  # from each byte on
    lengths = ends - starts
    low = eight[starts] & _MASKS[np.minimum(lengths, 8)]
    high = eight[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 7)] | np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)
    with np.errstate(over="ignore"):
        hashes = (low ^ low >> np.uint64(32)) * np.uint64(_BASES[0]) + (high ^ high >> np.uint64(29)) * np.uint64(_BASES[1])
        hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
    number: dict[bytes, int] = {}
    for i in np.flatnonzero(lengths > 15).tolist():
        word = raw[starts[i] : ends[i]]
        low[i], high[i], hashes[i] = number.setdefault(word, len(number)), 1 << 63 | 1 << 62, xxh3_64_intdigest(word)
    return low, high, hashes


class Chunk:
    """A chunk's documents, in the order of their ids and texts, as bytes with the words' places, names and hashes."""

    def __init__(self, docs: pa.Table, width: int):
        docs = docs.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.width, self.ids = width, docs.column("doc_id").to_pylist()
        texts = [(t or "").encode() for t in docs.column("text").to_pylist()]
        self.raw = b"\n".join([*texts, b""])
        self.starts, self.ends = word_places(self.raw)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, offsets)  # of each document's words, among all words
        self.sizes = np.diff(self.first)
        self.low_bytes, self.high_bytes, self.hashes = word_names(self.raw, self.starts, self.ends)
        gaps = np.ones(len(self.starts) + 1, dtype=np.int64)  # after a word: is it anything but one space?
        gaps[0] = 0
        if len(self.starts):
            gaps[1:-1] = (self.starts[1:] - self.ends[:-1] != 1) | (np.frombuffer(self.raw, dtype=np.uint8)[self.ends[:-1]] != 32)
        self.odd = np.cumsum(gaps)
        self._sums: list[tuple[np.ndarray, np.ndarray]] = []
        self._pieces: tuple[np.ndarray, np.ndarray] | None = None
        self._runs()

    def _runs(self) -> None:
        """The pieces: first and last window (places of their first words) and anchor of each."""
        n, width = len(self.hashes), self.width
        known = np.array([i is not None for i in self.ids], dtype=bool)
        self.named = np.array([i or 0 for i in self.ids], dtype=np.int64)
        ends = np.repeat(self.first[1:], self.sizes)
        self.doc_of = np.repeat(np.arange(len(self.ids)), self.sizes)
        valid = (np.arange(n) + width <= ends) & known[self.doc_of]
        if not valid.any():
            self.low = self.high = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=np.uint64)
            return
        size = min(GRAM, width)
        gram = _mixed(self.hashes, size)
        count = n - width + 1
        best, where = gram[:count].copy(), np.zeros(count, dtype=np.int64)
        for k in range(1, width - size + 1):
            less = gram[k : k + count] < best
            best[less] = gram[k : k + count][less]
            where[less] = k
        where += np.arange(count)
        windows = np.flatnonzero(valid[:count])
        breaks = np.flatnonzero((np.diff(windows) != 1) | (np.diff(where[windows]) != 0))
        self.low = windows[np.concatenate([[0], breaks + 1])]
        self.high = windows[np.concatenate([breaks, [len(windows) - 1]])]
        least = best[self.low]  # least hashes are small ones: mixed once more, they spread evenly over buckets and shards
        with np.errstate(over="ignore"):
            self.anchor = (least ^ least >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)

    def _prints(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of words start .. end - 1, by running sums."""
        with np.errstate(over="ignore"):
            if not self._sums:
                for base in _BASES:
                    powers = np.cumprod(np.full(len(self.hashes) + 1, base, dtype=np.uint64), dtype=np.uint64)
                    self._sums.append((np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * powers[:-1], dtype=np.uint64)]), powers))
            return [(total[end] - total[start]) * powers[len(powers) - 1 - start] + (end - start).astype(np.uint64) for total, powers in self._sums]

    def distinct(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different stretches of words, in an order of their own: the first (and so least) holder of each, for each
        stretch its number, and the last holder. Hashes bring equal stretches together, their words tell them apart."""
        a, b = self._prints(start, end)
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(order) else np.zeros(0, bool)
        if (clash := self._clashes(start[order], end[order], new)).any():
            # stretches whose hashes are equal though their words aren't: such groups go by the words themselves
            place = np.cumsum(new) - 1
            some = np.flatnonzero(np.isin(place, place[clash]))
            of = lambda i: self.raw[self.starts[start[i]] : self.ends[end[i] - 1]].split()
            words = [(int(place[i]), of(order[i]), i) for i in some.tolist()]
            words.sort()
            order[some] = order[[i for *_, i in words]]
            new[some] = [i == 0 or words[i][:2] != words[i - 1][:2] for i in range(len(words))]
        heads = np.flatnonzero(new)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return order[heads], number, order[np.append(heads[1:], len(order)) - 1] if len(order) else order

    def _clashes(self, start: np.ndarray, end: np.ndarray, new: np.ndarray) -> np.ndarray:
        """True for each stretch that has other words than the first one of its group; ``new`` is true for the first ones."""
        heads = np.flatnonzero(new)
        first = np.repeat(heads, np.diff(np.append(heads, len(new))))
        size = end - start
        out = size != size[first]
        some, step = np.flatnonzero(~new & ~out), 0
        while len(some):
            one, two = start[some] + step, start[first[some]] + step
            out[some] |= (self.low_bytes[one] != self.low_bytes[two]) | (self.high_bytes[one] != self.high_bytes[two])
            step += 1
            some = some[size[some] > step]
        return out

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The first run of each different piece, and for each run its piece."""
        if self._pieces is None:
            self._pieces = self.distinct(self.low, self.high + self.width)[:2]
        return self._pieces

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of all runs: their places, then as ``distinct`` gives it."""
        counts = self.high - self.low + 1
        places = np.repeat(self.low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return places, *self.distinct(places, places + self.width)

    def text(self, start: int, end: int) -> str:
        """Words start .. end - 1, with one space between."""
        part = self.raw[self.starts[start] : self.ends[end - 1]]
        return (part if self.odd[end - 1] == self.odd[start] else b" ".join(WORD_RE_BYTES.findall(part))).decode()

    def id_of(self, places: np.ndarray) -> np.ndarray:
        return self.named[self.doc_of[places]]


def _mixed(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive hashes."""
    n = max(0, len(hashes) - size + 1)
    total = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
            total ^= total >> np.uint64(29)
        return total * np.uint64(0xBF58476D1CE4E5B9)


def _edges(parts: int) -> np.ndarray:
    return np.array([(b << 64) // parts for b in range(1, parts)], dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that the shuffle's compression removes those that are alike."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, dtype=kind)


_COUNTED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("steps", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("kinds", pa.binary())])
_SENT = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("texts", pa.string()), ("numbers", pa.binary()), ("least", pa.binary()), ("several", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("least", pa.binary())])
_UNIQUE, _SHARED, _SPREAD = 0, 1, 2


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    heads, _ = chunk.pieces()
    return np.unique(chunk.anchor[heads], return_counts=True)


def _count(width: int, buckets: int) -> Callable:
    """Step 1, at the chunks: how many different pieces each anchor has."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        anchors, counts = _anchors(Chunk(docs, width))
        cuts = [0, *np.searchsorted(anchors, _edges(buckets), side="left").tolist(), len(anchors)]
        rows = []
        for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if j > i:
                steps, few = np.diff(anchors[i:j], prepend=np.uint64(0)), np.minimum(counts[i:j], 65_535).astype(np.uint16)
                rows.append({"bucket": b, "chunk": key[0].as_py(), "n": j - i, "steps": _planes(steps), "counts": _planes(few)})
        return pa.Table.from_pylist(rows, schema=_COUNTED)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, at the buckets: for each chunk's anchors, are they its own, shared, or of very many pieces?"""
    for group in sorted_groups(batches, ["bucket"]):
        rows = group.select(["chunk", "n", "steps", "counts"]).to_pylist()
        hashes = np.concatenate([np.cumsum(_unplanes(r["steps"], np.uint64, r["n"]), dtype=np.uint64) for r in rows])
        counts = np.concatenate([_unplanes(r["counts"], np.uint16, r["n"]) for r in rows]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        total = np.add.reduceat(counts[order], heads)
        kinds = np.empty(len(hashes), dtype=np.uint8)
        kinds[order] = np.repeat(np.where(total > HOT, _SPREAD, np.where(total > 1, _SHARED, _UNIQUE)), np.diff(np.append(heads, len(hashes))))
        at, out, bucket = 0, [], group.column("bucket")[0].as_py()
        for r in rows:
            out.append({"chunk": r["chunk"], "bucket": bucket, "n": r["n"], "kinds": kinds[at : at + r["n"]].tobytes()})
            at += r["n"]
        yield pa.RecordBatch.from_pylist(out, schema=_TOLD)


def _send(width: int, shards: int) -> Callable:
    """Step 2: pieces of shared anchors, and windows of those with very many, by shard. Windows have negative numbers."""

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(docs, width)
        heads, number = chunk.pieces()
        told = told.sort_by("bucket").column("kinds").to_pylist()
        kinds = np.frombuffer(b"".join(told), dtype=np.uint8)
        kind_of = kinds[np.searchsorted(_anchors(chunk)[0], chunk.anchor[heads])] if len(heads) else kinds
        out = np.flatnonzero(kind_of == _SHARED)
        start, end, numbers, hashes = chunk.low[heads[out]], chunk.high[heads[out]] + width, out, chunk.anchor[heads[out]]
        several = np.zeros(len(out), dtype=bool)
        if (kind_of == _SPREAD).any():
            places, first, of, last = chunk.windows()
            run_of = np.repeat(np.arange(len(chunk.low)), chunk.high - chunk.low + 1)
            apart = np.flatnonzero(kind_of[number[run_of[first]]] == _SPREAD)
            at = places[first[apart]]
            start, end = np.concatenate([start, at]), np.concatenate([end, at + width])
            numbers, hashes = np.concatenate([numbers, -1 - apart]), np.concatenate([hashes, _mixed(chunk.hashes, width)[at]])
            several = np.concatenate([several, chunk.id_of(at) != chunk.id_of(places[last[apart]])])
        shard = np.searchsorted(_edges(shards), hashes, side="right")
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(order) else np.zeros(1, int)
        least, rows = chunk.id_of(start), []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = order[i:j]
            texts = "\n".join(map(chunk.text, start[some].tolist(), end[some].tolist()))
            rows.append({"shard": int(shard[some[0]]), "chunk": key[0].as_py(), "texts": texts, "numbers": numbers[some].astype(np.int32).tobytes(), "least": _planes(least[some]), "several": np.packbits(several[some]).tobytes()})
        return pa.Table.from_pylist(rows, schema=_SENT)

    return run


def least_holders(pieces: list[list[str]], holders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the pieces, one piece after the other, its least holder, _LAST where no other piece has it; and the
    pieces' first windows. What recurs is confirmed by words, compiled, and found again by streaming all pieces."""
    number: dict[str, int] = {}
    give = number.setdefault
    codes = np.array([give(w, len(number) + 1) for words in pieces for w in (*words, "")], dtype=np.int64)  # "" ends a piece
    sizes = np.array([len(words) + 1 for words in pieces], dtype=np.int64)
    piece_of = np.repeat(np.arange(len(pieces)), sizes)
    word_hash = np.concatenate([[np.uint64(0)], np.fromiter((xxh3_64_intdigest(w.encode()) for w in number), dtype=np.uint64, count=len(number))])
    ends = np.repeat(np.cumsum(sizes) - 1, sizes)
    windows = np.flatnonzero(np.arange(len(codes)) + width <= ends)
    hashes = _mixed(word_hash[codes], width)[windows]
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    lengths = np.diff(np.append(heads, len(order)))
    again = np.flatnonzero(lengths > 1)
    # the first of each hash, and those with its hash but other words, which stand for themselves
    one = windows[order[heads[again]]]
    rest = np.repeat(one, lengths[again])
    all_of = windows[order[np.repeat(lengths > 1, lengths)]]
    differ = np.zeros(len(rest), dtype=bool)
    for k in range(width):
        differ |= codes[rest + k] != codes[all_of + k]
    confirmed = np.concatenate([one, all_of[differ]])
    least = np.full(len(codes), _LAST)
    for at in range(0, len(confirmed), AUTOMATON):
        part = confirmed[at : at + AUTOMATON]
        # a word is two symbols of few each, as a node's children are searched one by one; what the part lacks is (0, 0)
        used = np.unique(codes[part[:, None] + np.arange(width)])
        base = int(np.ceil(np.sqrt(len(used))))
        points = np.zeros((len(number) + 1, 2), dtype=np.uint32)
        points[used, 0], points[used, 1] = np.arange(len(used)) // base + 1, np.arange(len(used)) % base + base + 2
        text = points[codes].tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        keys = dict.fromkeys(text[2 * place : 2 * (place + width)] for place in part.tolist())
        for n, key in enumerate(keys):
            automaton.add_word(key, n)
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        found[:, 0] = (found[:, 0] + 1) // 2 - width
        holder = np.full(len(keys), _LAST)
        np.minimum.at(holder, found[:, 1], holders[piece_of[found[:, 0]]])
        least[found[:, 0]] = holder[found[:, 1]]
    return least[windows], np.concatenate([[0], np.cumsum(sizes - width)])


def _search(width: int) -> Callable:
    """Step 3: the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["shard"]):
            rows = group.select(["chunk", "texts", "numbers", "least", "several"]).to_pylist()
            number: dict[str, int] = {}  # pieces that chunks have alike are one
            give = number.setdefault
            piece = np.array([give(text, len(number)) for r in rows for text in r["texts"].split("\n")], dtype=np.int64)
            numbers = [np.frombuffer(r["numbers"], dtype=np.int32) for r in rows]
            own = np.concatenate([_unplanes(r["least"], np.int64, len(k)) for r, k in zip(rows, numbers, strict=True)])
            several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], dtype=np.uint8), count=len(k)) for r, k in zip(rows, numbers, strict=True)]).astype(bool)
            holders = np.full(len(number), _LAST)
            np.minimum.at(holders, piece, own)
            least, first = least_holders([text.split(" ") for text in number], holders, width)
            del number, give
            sizes = np.diff(first)
            least = np.minimum(least, np.repeat(holders, sizes))
            earlier = np.minimum.reduceat(least, first[:-1])[piece] < own
            out, at = [], 0
            for r, k in zip(rows, numbers, strict=True):
                some = np.flatnonzero(earlier[at : at + len(k)] | several[at : at + len(k)]) + at
                if len(some):
                    told = np.concatenate([least[first[i] : first[i + 1]] for i in piece[some].tolist()])
                    out.append({"chunk": r["chunk"], "numbers": k[some - at].tobytes(), "sizes": sizes[piece[some]].astype(np.int32).tobytes(), "least": _planes(told)})
                at += len(k)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)
        give_back()

    return run


def covered(chunk: Chunk, found: list[dict]) -> np.ndarray:
    """Step 4: of all of the chunk's words, those to remove. A window's least holder is that of its piece, if no shard has
    told otherwise."""
    heads, number = chunk.pieces()
    counts = chunk.high - chunk.low + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    least = np.repeat(chunk.id_of(chunk.low[heads])[number], counts) if len(number) else np.zeros(0, np.int64)
    if found:
        numbers = np.concatenate([np.frombuffer(r["numbers"], dtype=np.int32) for r in found]).astype(np.int64)
        sizes = np.concatenate([np.frombuffer(r["sizes"], dtype=np.int32) for r in found]).astype(np.int64)
        told = np.concatenate([_unplanes(r["least"], np.int64, len(r["least"]) // 8) for r in found])
        starts = np.cumsum(sizes) - sizes
        of_piece = np.full(len(heads), -1)
        of_piece[numbers[numbers >= 0]] = starts[numbers >= 0]
        runs = np.flatnonzero(of_piece[number] >= 0)
        into = np.repeat(first[runs] - np.concatenate([[0], np.cumsum(counts[runs])[:-1]]), counts[runs]) + np.arange(counts[runs].sum())
        least[into] = told[np.repeat(of_piece[number[runs]] - first[runs], counts[runs]) + into]
        if (numbers < 0).any():
            _, _, of, _ = chunk.windows()
            of_window = np.full(of.max() + 1, -1)
            of_window[-1 - numbers[numbers < 0]] = starts[numbers < 0]
            some = np.flatnonzero(of_window[of] >= 0)
            least[some] = told[of_window[of[some]]]
    places = np.repeat(chunk.low - first[:-1], counts) + np.arange(first[-1])
    gone = places[least < chunk.id_of(places)]
    change = np.zeros(len(chunk.doc_of) + 1, dtype=np.int64)
    np.add.at(change, gone, 1)
    np.add.at(change, gone + chunk.width, -1)
    return np.cumsum(change[:-1]) > 0


def _locate(width: int, digests: bool) -> Callable:
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(docs, width)
        gone = covered(chunk, found.select(["numbers", "sizes", "least"]).to_pylist())
        return _fill(chunk, gone, digests)

    return run


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(chunk: Chunk, gone: np.ndarray) -> Iterator[str]:
    """Of each document the words that stay, run by run."""
    for i, j in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gone[i:j], [True]]))) + i
        yield " ".join(map(chunk.text, edges[::2].tolist(), edges[1::2].tolist()))


def _fill(chunk: Chunk, gone: np.ndarray, digests: bool) -> pa.Table:
    kept = _kept(chunk, gone)
    if digests:
        kept = (hashlib.sha256(text.encode()).hexdigest() for text in kept)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.first])
    return pa.table([pa.array(chunk.ids, pa.int64()), chunk.sizes, removed, pa.array(list(kept), pa.string())], schema=_DIGESTS if digests else _TEXTS)


def remove_repeats(docs: DataFrame, width: int = 13, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept (the words that stay, joined by a space).

    A word goes if a window of ``width`` words covers it whose words also start a window in a document of a smaller id;
    windows are judged on the input. ``digests`` gives kept_sha256 in place of kept. Null and empty texts have no words.
    A null id is neither smaller nor greater than another, so such a row keeps all its words and takes none from others.
    Rows of one id take none from each other, so repeated rows give repeated results. Other columns aren't read. A
    document of any length, and of any number of different words, is whole in one task.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # as many partitions as the data need, whatever the session's number; one exchange of the texts serves all groupings
    chunks = max(1, -(-n_bytes // CHUNK_BYTES))
    buckets, shards = max(least, -(-n_bytes // BUCKET_BYTES)), max(least, -(-n_bytes // SHARD_BYTES))
    parts = max(least, -(-chunks // CHUNKS_PER_PARTITION))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition(parts, "chunk")
    at_chunk = dealt.groupBy("chunk")
    counted = at_chunk.applyInArrow(_count(width, buckets), _ddl(_COUNTED))
    told = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare, _ddl(_TOLD)).repartition(parts, "chunk")
    sent = at_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_send(width, shards), _ddl(_SENT))
    found = sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_search(width), _ddl(_FOUND)).repartition(parts, "chunk")
    return at_chunk.cogroup(found.groupBy("chunk")).applyInArrow(_locate(width, digests), _ddl(_DIGESTS if digests else _TEXTS))
