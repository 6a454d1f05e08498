"""BPE encoding and decoding with a compiled lexicon of frequent words (operator 12).

Spark counts the words (pre-tokens) of the whole corpus. Those that make up at least a given share of it, so at most
1 / share of them, are encoded by exact merges and compiled into a minimal acyclic transducer: states with equal futures
are one, and ids stand on the arcs as early as all words beyond an arc agree on them (sorted words are added one by one,
and a state is looked up among the finished ones once no later word can change it). Its arrays are written to one
file, which Spark brings to every executor and workers map into memory, so all workers of a machine share its pages.

Texts are encoded by running the distinct words of a batch through the transducer in lockstep; words that it doesn't
hold are merged exactly, so the lexicon only decides how fast a word is encoded and never which ids it gets.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import checkpoint, give_back, put_file, shared_folder

#: A frequent word is met twice at least and is this share of all words; a longer word is always merged.
SHARE, LONGEST = 1e-6, 64
#: Different words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Characters of texts that are worked on together.
BATCH_CHARS = 2_000_000
_MAGIC = 0x6C78_6963_6F6E_0001


def _byte_letters() -> list[str]:
    """The printable letter that byte-level files write for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_SPACE, _LETTER, _NUMBER, _OTHER, _NEWER = range(5)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point. Those that Python's tables don't know are apart: the library's may be newer."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((_NEWER if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], _OTHER) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


#: The split of the file that is compiled: contractions, runs of letters, single numbers, runs of others.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point of each word and the one after it, of a text that ends with white space."""
    kinds = _classes()[points]
    cut = np.ones(len(kinds), dtype=bool)
    cut[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
    # an apostrophe before a letter, if it is a run of its own, takes s, t, m, d, re, ve and ll with it
    marks = np.flatnonzero((points == 0x27) & cut & (np.append(kinds[1:], _SPACE) == _LETTER))
    if len(marks):
        one, two = points[marks + 1], points[np.minimum(marks + 2, len(points) - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut[marks[single | double] + 1] = False
        cut[marks[single] + 2] = True
        cut[marks[double] + 3] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(points))
    real = kinds[starts] != _SPACE
    return starts[real], ends[real]


class WordBPE:
    """A tokenizer file of kind BPE with word ends: its words, its exact merges, and its ids' strings.

    Its normaliser (NFC, white space, lower case letter by letter) is applied by built-in functions and its split by arrays
    of classes; where a text holds code points that are newer than Python's tables, by the library's own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, letters = (spec["pre_tokenizer"].get("pretokenizers") or [{}, {}])[:2]
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("unk_token") or spec.get("decoder"))
        plain = plain and not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        if not (plain and model.get("type") == "BPE" and steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex") == SPLIT and letters.get("type") == "ByteLevel" and not letters.get("add_prefix_space") and not letters.get("use_regex")):
            raise ValueError(f"{path} isn't a BPE file with word ends, lower case and a splitting pattern")
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters, self.suffix = _byte_letters(), model.get("end_of_word_suffix") or ""
        missing = [c for c in self.letters if c not in self.ids or c + self.suffix not in self.ids]
        if missing:
            raise ValueError(f"{path} has no ids for some bytes: {missing[:5]}")
        self.ranks: dict[int, int] = {}  # of a pair of ids, packed; and by rank the id of their token
        self.made = np.zeros(len(model["merges"]), dtype=np.int64).tolist()
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.made[rank] = self.ids[left + right]
            self.ranks.setdefault(self.ids[left] << 20 | self.ids[right], rank)
        self.merge = lru_cache(100_000)(self._merge)
        self.inner = [self.ids[c] for c in self.letters]
        self.last = [self.ids[c + self.suffix] for c in self.letters]
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.strings = np.full(max([*self.ids.values(), *self.special.values()]) + 1, "", dtype=object)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = token

    def _plain(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Words of texts without added tokens, one text after the other, and how many each has."""
        held = []
        for text in texts:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma, as letters are lowered one by one
            held.append(text.lower() + "\n")
        joined = "".join(held)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum(list(map(len, held)))
        if not joined.isascii() and (newer := np.flatnonzero(_classes()[points] == _NEWER)).size:
            strange = set(np.searchsorted(ends, newer, side="right").tolist())
            parts = [self._by_library(t) if i in strange else self._plain([t])[0] for i, t in enumerate(texts)]
            return [w for part in parts for w in part], list(map(len, parts))
        start, end = word_bounds(points)
        words = [joined[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return words, np.diff(np.concatenate([[0], np.searchsorted(start, ends)])).tolist()

    def _by_library(self, text: str) -> list[str]:
        inverse = {c: b for b, c in enumerate(self.letters)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(inverse[c] for c in word).decode() for word, _ in found]

    def words(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The words of texts, one text after the other, and how many each has; strings of added tokens stand for themselves."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            return self._plain(texts)
        out, counts = [], []
        for text in texts:
            before = len(out)
            for part in self.cut.split(text):
                out += [part] if part in self.special else self._plain([part or ""])[0]
            counts.append(len(out) - before)
        return out, counts

    def _merge(self, word: str) -> list[int]:
        """The ids of a word by exact merges: always the pair of least rank, the leftmost of equals."""
        if word in self.special:
            return [self.special[word]]
        raw, get, none = word.encode(), self.ranks.get, len(self.made)
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if len(ids) > 64:
            return self._merge_long(ids)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i : i + 2] = [self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a queue of pairs, in n log n steps."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i) for i in range(n - 1) if (rank := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i] = token = self.made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get(token << 20 | ids[k])) is not None:
                    heapq.heappush(queue, (rank, i))
            if (h := before[i]) >= 0 and (rank := get(ids[h] << 20 | token)) is not None:
                heapq.heappush(queue, (rank, h))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The strings of the ids joined by one space, special tokens too; the file names no decoder."""
        return " ".join(self.strings[ids].tolist())


@lru_cache(2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte: state, ids
        self.final, self.tail = False, ()

    def frozen(self) -> tuple:
        return self.final, self.tail, tuple((b, to, ids) for b, (to, ids) in self.arcs.items())


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of the minimal transducer of sorted, distinct, non-empty words with their ids."""
    known: dict[tuple, int] = {}
    path, word = [_State()], b""

    def finish(upto: int) -> None:
        for i in range(len(word), upto, -1):
            path[i - 1].arcs[word[i - 1]][0] = known.setdefault(path.pop().frozen(), len(known))

    for new, ids in entries:
        if new <= word:
            raise ValueError("words must be sorted and distinct")
        shared = 0
        while shared < min(len(word), len(new)) and word[shared] == new[shared]:
            shared += 1
        finish(shared)
        for i in range(shared):  # an arc keeps the ids that all words beyond it begin with
            arc = path[i].arcs[new[i]]
            same = 0
            while same < min(len(arc[1]), len(ids)) and arc[1][same] == ids[same]:
                same += 1
            arc[1], rest, ids = arc[1][:same], arc[1][same:], ids[same:]
            if rest:
                for onward in path[i + 1].arcs.values():
                    onward[1] = rest + onward[1]
                if path[i + 1].final:
                    path[i + 1].tail = rest + path[i + 1].tail
        for i in range(shared, len(new)):
            path[i].arcs[new[i]] = [None, ids if i == shared else ()]
            path.append(_State())
        path[-1].final = True
        word = new
    finish(0)
    start = known.setdefault(path[0].frozen(), len(known))

    pool: dict[tuple, int] = {}
    flat: list[int] = []

    def place(ids: tuple) -> tuple[int, int]:
        if ids not in pool:
            pool[ids] = len(flat)
            flat.extend(ids)
        return pool[ids], len(ids)

    arcs, ends = [], []
    for number, (final, tail, out) in enumerate(known):
        ends.append((final, *place(tail)))
        arcs += [(number << 8 | b, to, *place(ids)) for b, to, ids in out]
    keys, goes, at, size = np.array(arcs, dtype=np.int64).reshape(-1, 4).T
    final, tail_at, tail_size = np.array(ends, dtype=np.int64).T
    head = np.array([_MAGIC, start, len(keys), len(final), len(flat)], dtype=np.int64)
    return b"".join(x.astype(np.int64).tobytes() for x in (head, keys, goes, at, size, final, tail_at, tail_size, np.array(flat, dtype=np.int64)))


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, data: np.ndarray):
        magic, self.start, n_arcs, n_states, n_ids = data[:5].tolist()
        if magic != _MAGIC:
            raise ValueError("not a lexicon")
        cuts = np.cumsum([5, n_arcs, n_arcs, n_arcs, n_arcs, n_states, n_states, n_states, n_ids])
        self.keys, self.goes, self.at, self.size, self.final, self.tail_at, self.tail_size, self.ids = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, dtype=np.int64, mode="r"))

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the lexicon has each word, how many ids it has, and the ids of one word after the other."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        begins = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.start, dtype=np.int64)
        known = np.zeros(len(words), dtype=bool)
        live, step = np.flatnonzero(lengths <= LONGEST), 0
        said = [np.zeros((3, 0), dtype=np.int64)]  # word, place of ids, their number, in the order of steps
        while len(live):
            ended = lengths[live] == step
            known[live[ended]] = self.final[state[live[ended]]] > 0
            live = live[~ended]
            keys = state[live] << 8 | data[begins[live] + step]
            arcs = np.searchsorted(self.keys, keys)
            arcs[arcs == len(self.keys)] = 0
            held = self.keys[arcs] == keys if len(self.keys) else np.zeros(len(live), dtype=bool)
            live, arcs = live[held], arcs[held]
            state[live] = self.goes[arcs]
            spoken = self.size[arcs] > 0
            said.append(np.stack([live[spoken], self.at[arcs[spoken]], self.size[arcs[spoken]]]))
            step += 1
        tails = np.flatnonzero(known & (self.tail_size[state] > 0))
        said.append(np.stack([tails, self.tail_at[state[tails]], self.tail_size[state[tails]]]))
        word, at, size = np.concatenate(said, axis=1)
        order = np.argsort(word, kind="stable")
        order = order[known[word[order]]]
        word, at, size = word[order], at[order], size[order]
        sizes = np.bincount(word, weights=size, minlength=len(words)).astype(np.int64)
        ends = np.cumsum(size)
        return known, sizes, self.ids[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null as empty, in runs of bounded size; a longer text is a run of its own."""
    part, chars = [], 0
    for text in texts:
        text = text or ""
        if part and chars + len(text) > BATCH_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


def frequent_words(docs: DataFrame, path: str, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """(word, ids) of the words that are at least ``share`` of all words of all texts: at most 1 / share rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found, total = tokenizer(path), Counter(), 0

        def told() -> pa.RecordBatch:
            short = [w for w in found if len(w) <= LONGEST and (w.isascii() or len(w.encode()) <= LONGEST) and w not in model.special]
            return pa.RecordBatch.from_arrays([pa.array([None, *short], pa.string()), pa.array([total, *map(found.__getitem__, short)], pa.int64())], names=["word", "n"])

        for batch in batches:
            for texts in _slices(batch.column(0).to_pylist()):
                words, _ = model.words(texts)
                found.update(words)
                total += len(words)
                if len(found) > HELD_WORDS:
                    yield told()
                    found, total = Counter(), 0
        if total:
            yield told()
        del found
        give_back()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(model.merge, batch.column(0).to_pylist()), pa.list_(pa.int32()))], names=["word", "ids"])

    counts = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts.where("n > 1 or word is null"))  # the row without a word counts all words
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("word").isNotNull() & (F.col("n") >= share * total)).select("word").mapInArrow(encode, "word string, ids array<int>")


def lexicon_file(docs: DataFrame, path: str, share: float = SHARE, text_col: str = "text") -> str:
    """Compile the frequent words and give every executor the file; its name for ``SparkFiles``."""
    spark = docs.sparkSession
    words = [(r.word.encode(), tuple(r.ids)) for r in frequent_words(docs, path, share, text_col).collect()]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = f"{shared_folder(spark)}/{name}"
    put_file(spark, place, compile_lexicon(sorted(words)))
    spark.sparkContext.addFile(place)
    return name


def encode_texts(docs: DataFrame, path: str, share: float = SHARE, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each document, with ``decoded`` what the ids decode to as well: the ids that the file's library gives, without added tokens but with those whose
    strings a text holds, as it has them by default, and without truncation or padding.

    A null text counts as empty and has no ids. Each row is encoded alone, so null ids and repeated rows need no rule; other
    columns aren't read. Texts are encoded whole; a word of any length is merged exactly in n log n steps.
    """
    name = lexicon_file(docs, path, share, text_col)
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = tokenizer(path), Lexicon.open(SparkFiles.get(name))
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1).to_pylist()):
                words, counts = model.words(texts)
                number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                known, sizes, pool = lexicon.look_up([w.encode() for w in number])
                unseen = [model.merge(w) for w, held in zip(number, known.tolist(), strict=True) if not held]
                places = np.cumsum(sizes) - sizes
                sizes[~known] = few = np.fromiter(map(len, unseen), dtype=np.int64, count=len(unseen))
                places[~known] = len(pool) + np.cumsum(few) - few
                pool = np.concatenate([pool, np.fromiter(chain.from_iterable(unseen), dtype=np.int64)]).astype(np.int32)
                which = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
                each = sizes[which]
                upto = np.concatenate([[0], np.cumsum(each)])
                flat = pool[np.repeat(places[which] - upto[:-1], each) + np.arange(upto[-1])]
                ends = upto[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                columns = [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(ends, flat)]
                if decoded:
                    columns.append(pa.array([model.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at += len(texts)
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """All columns and ``decoded``: what the file's library decodes the ids to, special tokens kept. Null ids give null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decode(ids):
        model = tokenizer(path)
        return ids.map(lambda x: None if x is None else model.decode(x))

    return encoded.withColumn("decoded", decode("ids"))


def digests(encoded: DataFrame) -> DataFrame:
    """Per document the number of tokens and SHA-256 of its ids and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
