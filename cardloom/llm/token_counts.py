"""Token counts by a compiled finite-state tokenizer (operator 2).

A byte-level BPE tokenizer is compiled into two deterministic transducers:

* the *splitter* reads character classes and says where pre-tokens begin. It has eleven states, so a chunk of text is
  a map from states to states. The maps of all chunks compose through a parallel prefix scan, which gives the state
  in which each chunk begins; then all chunks run in lockstep.
* the *counter* reads the bytes of one pre-token. Its transitions carry the change of the number of emitted tokens
  (which a later byte can lower, when it merges tokens). It is made state by state as texts need it: a state holds the
  last token of every prefix whose rest can still grow into a token, which is all that later bytes depend on. Every
  contiguous part of a BPE encoding is the encoding of its own text, so the last token of each prefix follows from the
  pairs of tokens that can stand side by side.

A long pre-token is cut too: its chunks are read at once, each from the state that a short run-up leads to, and their maps
compose from the left. No merge is replayed per word: the hot loop is table look-ups on arrays. Files of another kind than byte-level BPE
(``sentencepiece`` models, BPE with word ends) are counted by their own library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 256
#: A chunk whose last characters already lead to one state has a constant map; only the others are read in full.
SUFFIX = 16
#: Characters that are run through the transducers at a time.
BATCH_CHARS = 4_000_000
#: Bytes of a pre-token beyond which it is cut; bytes of its chunks, of the run-up to each, and chunks that are tried ahead.
LONG, LONG_CHUNK, RUN_UP, AHEAD = 4096, 512, 64, 64
#: The counter starts anew beyond this many states (5 bytes for each byte value that texts hold, and some 300).
MAX_STATES = 250_000

_LETTER, _NUMBER, _SPACE, _WHITE, _OTHER, _APOSTROPHE = range(6)
_S, _T, _M, _D, _R, _E, _V, _L = range(6, 14)
_END, _PAD = 14, 15
_SMALL = {"s": _S, "t": _T, "m": _M, "d": _D, "r": _R, "e": _E, "v": _V, "l": _L}
_LETTERS = {_LETTER, *_SMALL.values()}

_CONTINUE, _HERE, _BEFORE, _BOTH = range(4)
_START, _IN_LETTERS, _IN_NUMBERS, _IN_OTHER, _AFTER_SPACE, _AFTER_WHITE, _AFTER_APOSTROPHE, _AFTER_R, _AFTER_V, _AFTER_L, _CONTRACTION = range(11)
_STATES = 11


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and where a pre-token begins (here, one character before, both), by state * 16 + class."""
    run = {_NUMBER: _IN_NUMBERS, _SPACE: _AFTER_SPACE, _WHITE: _AFTER_WHITE, _OTHER: _IN_OTHER, _APOSTROPHE: _AFTER_APOSTROPHE, _END: _START}
    run |= dict.fromkeys(_LETTERS, _IN_LETTERS)
    pending = {_AFTER_R: _E, _AFTER_V: _E, _AFTER_L: _L}
    goes = np.zeros((_STATES, 16), dtype=np.uint8)
    does = np.zeros((_STATES, 16), dtype=np.uint8)
    for state in range(_STATES):
        for c in range(15):
            step = (run[c], _HERE)
            white = c in (_SPACE, _WHITE)
            if state == _IN_LETTERS and c in _LETTERS or state == _IN_NUMBERS and c == _NUMBER:
                step = (state, _CONTINUE)
            elif state == _IN_OTHER and c in (_OTHER, _APOSTROPHE):
                step = (_IN_OTHER, _CONTINUE)
            elif state in (_AFTER_SPACE, _AFTER_WHITE) and c != _END:
                if white:
                    step = (run[c], _CONTINUE)
                elif state == _AFTER_SPACE:
                    step = (_IN_OTHER if c == _APOSTROPHE else run[c], _BEFORE)
                else:
                    step = (run[c], _BOTH)
            elif state == _AFTER_APOSTROPHE:
                if c in (_S, _T, _M, _D):
                    step = (_CONTRACTION, _CONTINUE)
                elif c in (_R, _V, _L):
                    step = ({_R: _AFTER_R, _V: _AFTER_V, _L: _AFTER_L}[c], _CONTINUE)
                elif c in (_OTHER, _APOSTROPHE):
                    step = (_IN_OTHER, _CONTINUE)
            elif state in pending:
                if c == pending[state]:
                    step = (_CONTRACTION, _CONTINUE)
                elif c in _LETTERS:
                    step = (_IN_LETTERS, _BEFORE)
                else:
                    step = (run[c], _BOTH)
            goes[state, c], does[state, c] = step
        goes[state, _PAD] = state
    return goes.ravel(), does.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, c in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\p{White_Space}", _WHITE)):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = c
    out[ord(" ")], out[ord("'")] = _SPACE, _APOSTROPHE
    for letter, c in _SMALL.items():
        out[ord(letter)] = c
    return out


def pretoken_starts(classes: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; ``classes`` has _END after each text."""
    goes, does = _splitter()
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, _PAD, dtype=np.uint8)
    padded[:n] = classes
    rows = padded.reshape(chunks, CHUNK)
    columns = np.ascontiguousarray(rows.T)

    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (chunks, 1))
    for at in range(CHUNK - SUFFIX, CHUNK):
        maps = goes[maps.astype(np.intp) * 16 + columns[at][:, None]]
    open_chunks = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    if len(open_chunks):
        part = np.tile(np.arange(_STATES, dtype=np.uint8), (len(open_chunks), 1))
        for at in range(CHUNK):
            part = goes[part.astype(np.intp) * 16 + columns[at][open_chunks][:, None]]
        maps[open_chunks] = part
    reach = 1  # after each round a row composes the maps of the `reach` chunks that end with it
    while reach < chunks and (maps != maps[:, :1]).any():
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.zeros(chunks, dtype=np.uint8)
    state[1:] = maps[:-1, _START]

    acts = np.empty((CHUNK, chunks), dtype=np.uint8)
    for at in range(CHUNK):
        index = state.astype(np.intp) * 16 + columns[at]
        acts[at] = does[index]
        state = goes[index]
    flat = np.ascontiguousarray(acts.T).ravel()[:n]
    starts = (flat == _HERE) | (flat == _BOTH)
    starts[:-1] |= (flat[1:] == _BEFORE) | (flat[1:] == _BOTH)
    return starts


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level files write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer of one byte-level BPE file, made as needed."""

    def __init__(self, spec: dict):
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = set(self.special)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in added}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # rank, left and right part of a merged token
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = as_bytes(a), as_bytes(b)
            pair = self.ids[left], self.ids[right]
            self.ranks[pair] = rank
            self.made.setdefault(self.ids[left + right], (rank, *pair))
        self.grows = {b[:k] for b in self.ids for k in range(1, len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._begin()

    def _begin(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.parts: dict[tuple, tuple] = {}
        self.column = np.full(256, -1, dtype=np.int16)  # of each byte value that was met
        self.byte: list[int] = []
        self.goes = np.full((1024, 64), -1, dtype=np.int32)
        self.adds = np.zeros((1024, 64), dtype=np.int8)
        self._state(((b"", -1, 0),))

    def _state(self, key: tuple) -> int:
        if (found := self.known.get(key)) is not None:
            return found
        at = self.known[key] = len(self.states)
        self.states.append(key)
        if at == len(self.goes):
            self._grow(0)
        return at

    def _grow(self, axis: int) -> None:
        self.goes = np.concatenate([self.goes, np.full_like(self.goes, -1)], axis=axis)
        self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)], axis=axis)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        for byte in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            if len(self.byte) == self.goes.shape[1]:
                self._grow(1)
            self.column[byte] = len(self.byte)
            self.byte.append(byte)
        return self.column.astype(np.uint8)[data]

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether an encoding can hold token a before token b.

        Merges that reach their border never happen: the tokens at the border are undone, the latest merge first, and
        none of the pairs met there may merge earlier than the tokens it would break.
        """
        if (known := self.pairs.get((a, b))) is not None:
            return known
        left, right, before, known = a, b, 1 << 60, True
        while True:
            if (met := self.ranks.get((left, right))) is not None and met < before:
                known = False
                break
            of_left, of_right = self.made.get(left), self.made.get(right)
            if of_left is None and of_right is None:
                break
            # At equal ranks, the same token twice, the one to the left was made first.
            if of_right is None or of_left is not None and of_left[0] > of_right[0]:
                before, left = of_left[0], of_left[2]
            else:
                before, right = of_right[0] + 1, of_right[1]
        self.pairs[a, b] = known
        return known

    def _compile(self, state: int, column: int) -> None:
        byte = self.byte[column]
        live, b = self.states[state], bytes([byte])
        for rest, last, count in live:  # the longest rest first
            token = self.ids.get(rest + b)
            if token is not None and (last < 0 or self._side_by_side(last, token)):
                break
        else:
            raise ValueError(f"no token ends with byte {byte}; the file isn't a byte-level BPE")
        now = count + 1
        kept = [(rest + b, last, c - now) for rest, last, c in live if rest + b in self.grows]
        following = self._state(tuple(self.parts.setdefault(part, part) for part in (*kept, (b"", token, 0))))
        self.goes[state, column], self.adds[state, column] = following, now

    def _run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each of some stretches of bytes (as columns), read from a state each, and the tokens that they add."""
        order = np.argsort(-lengths.astype(np.int64), kind="stable") if len(lengths) and lengths.max() > 60_000 else np.argsort(np.uint16(65_535) - lengths.astype(np.uint16), kind="stable")
        at, left, state, counts = starts[order], lengths[order], state[order].astype(np.int32), np.zeros(len(order), dtype=np.int32)
        active = len(order)
        step = 0
        while active:
            if left[active - 1] <= step:
                active = int(np.searchsorted(-left[:active], -step, side="left"))
                continue
            byte = data[at[:active] + step]
            goes = self.goes[state[:active], byte]
            missing = np.flatnonzero(goes < 0)
            if len(missing):
                for key in np.unique(state[missing].astype(np.int64) * 256 + byte[missing]).tolist():
                    self._compile(key >> 8, key & 255)
                goes = self.goes[state[:active], byte]
            counts[:active] += self.adds[state[:active], byte]
            state[:active] = goes
            step += 1
        ends, out = np.empty_like(state), np.empty_like(counts)
        ends[order], out[order] = state, counts
        return ends, out

    def _long(self, data: np.ndarray, start: int, length: int) -> int:
        """Tokens of one long pre-token, cut in chunks.

        Each chunk's map from states to states and counts is made for the states that it is met in: at first for the one
        that a short run-up leads to, of all chunks in lockstep, as states forget what is far behind. Then the maps are
        composed from the left, and where a chunk is met in another state, it and those after it are read from that state too.
        """
        begins = np.arange(start, start + length, LONG_CHUNK)
        sizes = np.minimum(LONG_CHUNK, start + length - begins)
        number: dict[bytes, int] = {}
        kind = [number.setdefault(data[a : a + n].tobytes(), len(number)) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
        first = {k: i for i, k in reversed(list(enumerate(kind)))}
        run_up = np.minimum(RUN_UP, begins - start)
        guess, _ = self._run(data, begins - run_up, run_up, np.zeros(len(begins), dtype=np.int32))
        maps: dict[tuple[int, int], tuple[int, int]] = {}

        def learn(pairs: list[tuple[int, int]]) -> None:
            some = np.array([first[k] for _, k in pairs])
            found = self._run(data, begins[some], sizes[some], np.array([s for s, _ in pairs], dtype=np.int32))
            maps.update(zip(pairs, zip(*(x.tolist() for x in found), strict=True), strict=True))

        learn(list(dict.fromkeys(zip(guess.tolist(), kind, strict=True))))
        state = total = 0
        for i, k in enumerate(kind):
            if (state, k) not in maps:
                learn([(state, x) for x in dict.fromkeys(kind[i : i + AHEAD]) if (state, x) not in maps])
            state, n = maps[state, k]
            total += n
        return total

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token ``data[start : start + length]``."""
        if len(self.states) > MAX_STATES:
            self._begin()
        data = self._columns(data)
        long = np.flatnonzero(lengths > LONG)
        out = np.zeros(len(starts), dtype=np.int64)
        short = np.flatnonzero(lengths <= LONG)
        out[short] = self._run(data, starts[short], lengths[short], np.zeros(len(short), dtype=np.int32))[1]
        for i in long.tolist():
            out[i] = self._long(data, int(starts[i]), int(lengths[i]))
        return out

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an added token's own string counts as one, as the library has it by default."""
        pieces, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        for i, text in enumerate(texts):
            if cut and any(s in text for s in self.special):
                parts = cut.split(text)
                extra[i] = len(parts) - 1
            else:
                parts = [text]
            pieces += parts
            owner += [i] * len(parts)
        joined = "\x00".join(pieces) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        classes = _classes()[points]
        classes[ends] = _END
        flags = pretoken_starts(classes)
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        offsets = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.flatnonzero(flags)
        starts = offsets[begins]
        lengths = np.diff(np.append(starts, len(data)))
        real = classes[begins] != _END
        counts = np.zeros(len(starts), dtype=np.int64)
        counts[real] = self.count(data, starts[real], lengths[real])
        total = np.concatenate([[0], np.cumsum(counts)])
        upto = total[np.searchsorted(begins, ends, side="left")]
        each = np.diff(np.concatenate([[0], upto]))
        return extra + np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)


class _Library:
    """Counts by the file's own library, for kinds that aren't compiled."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count_texts = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.count_texts = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _plain_byte_bpe(spec: dict) -> bool:
    """True for what the transducers stand for: GPT-2's split, no normaliser, whole bytes in the vocabulary."""
    model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    return plain and spec.get("normalizer") is None and model.get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and all(c in model["vocab"] for c in _byte_letters())


@lru_cache(4)
def counter(path: str):
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if _plain_byte_bpe(spec):
            return Counter(spec)
    return _Library(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty (0 and 0, false); null ids, repeated rows and other columns change nothing, as each row
    is counted alone and other columns aren't read. Long texts are cut between chunks by the transducers, never dropped.
    ``path`` is read on each executor, where the tokenizer files are installed.
    """
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            counts, part, chars, first = [], [], 0, True
            for text in texts:
                if part and chars + len(text) > BATCH_CHARS:
                    counts.append(np.asarray(model.count_texts(part)))
                    part, chars = [], 0
                part.append(text)
                chars += len(text) + 1
            if part:
                counts.append(np.asarray(model.count_texts(part)))
            tokens = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
