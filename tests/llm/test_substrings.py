import hashlib
import random
import re

import numpy as np
import pytest

from cardloom.llm import substrings

SCHEMA = "doc_id long, text string, lang string, chunk long, n int"


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                least[k] = min(d, least.get(k, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ça", "d e", "Ff", "\U0001f600", "x" * 40])
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [word() + str(rng.random()) for _ in range(rng.randint(1, 20))]
        rows.append((rng.randint(0, 1000) if i % 7 else i, rng.choice([" ", "\n", " \t"]).join(w)))
    return [*rows, rows[3], rows[3], (None, " ".join(passages[0] * 3)), (5000, None), (5001, ""), (5002, "w " * 30_000), (5003, "w " * 40)]


@pytest.mark.parametrize(("seed", "size", "hot"), [(1, 10**9, 20_000), (2, 2000, 20_000), (3, 300, 20_000), (4, 2000, 2), (5, 10**9, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, size, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", size)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 5_000)
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, "en", 7, 1) for d, t in rows], SCHEMA)
    got = sorted(map(tuple, substrings.remove_repeats(docs, digests=True).collect()), key=str)
    assert got == brute(rows)


def test_texts_and_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substrings.remove_repeats(docs).count() == 0
    text = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(1, text, "", 0, 0), (2, f"new {text} end", "", 0, 0)], SCHEMA)
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect())) == [(1, 20, 0, text), (2, 22, 20, "new end")]


def holders_by_brute(pieces, holders, width):
    least = {}
    for words, h in zip(pieces, holders, strict=True):
        for i in range(len(words) - width + 1):
            k = tuple(words[i : i + width])
            least[k] = min(h, least.get(k, h))
    return [least[tuple(words[i : i + width])] for words in pieces for i in range(len(words) - width + 1)]


def test_equal_hashes_of_other_words_are_told_apart(monkeypatch):
    """All windows get one of three hashes; words decide, in automata of few windows."""
    rng = random.Random(3)
    pieces = [[rng.choice("abc") for _ in range(rng.randint(4, 9))] for _ in range(200)]
    holders = np.array([rng.randrange(1000) for _ in pieces], dtype=np.int64)
    want = holders_by_brute(pieces, holders.tolist(), 4)
    mixed = substrings._mixed
    for mod, few in ((3, 60_000), (2**63, 5)):
        monkeypatch.setattr(substrings, "_mixed", lambda h, size, mod=mod: mixed(h, size) % np.uint64(mod))
        monkeypatch.setattr(substrings, "AUTOMATON", few)
        got, first = substrings.least_holders(pieces, holders, 4)
        own = np.repeat(holders, np.diff(first))
        assert np.minimum(got, own).tolist() == want


def test_many_different_words(spark):
    """More different words in one document than there are code points."""
    tail = " ".join(f"t{i}" for i in range(30))
    rows = [(1, tail), (2, " ".join(map(str, range(1_200_000))) + " " + tail)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame([(d, t, "", 0, 0) for d, t in rows], SCHEMA), digests=True).collect()}
    assert got == {1: (30, 0), 2: (1_200_030, 30)}


def test_words_that_polynomials_of_powers_of_two_confuse(spark):
    """Two words of 1,024 letters in the order of Thue and Morse and its complement, after twelve equal words."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}")]
    got = sorted(map(tuple, substrings.remove_repeats(spark.createDataFrame([(d, t, "", 0, 0) for d, t in rows], SCHEMA), digests=True).collect()))
    assert got == brute(rows) and [r[2] for r in got] == [0, 0, 13]


def test_names_are_shared_by_equal_words_alone():
    rng = random.Random(5)
    words = ["".join(rng.choices("ab\x00", k=rng.choice([1, 2, 7, 8, 9, 14, 15, 16, 17, 300]))) for _ in range(4000)]
    raw = (" ".join(words) + "\n").encode()
    low, high, hashes = substrings.word_names(raw, *substrings.word_places(raw))
    of = {}
    for word, *name in zip(words, low.tolist(), high.tolist(), hashes.tolist(), strict=True):
        assert of.setdefault(word, name) == name
    assert len({tuple(n[:2]) for n in of.values()}) == len(of) == len({n[2] for n in of.values()})


@pytest.mark.parametrize("seed", [6, 7])
def test_chunks_whose_hashes_clash(monkeypatch, seed):
    """Words have one of two hashes, so that many different stretches have equal ones."""
    import pyarrow as pa

    names = substrings.word_names
    monkeypatch.setattr(substrings, "word_names", lambda *a: ((x := names(*a))[0], x[1], np.uint64(1) + (x[0] & np.uint64(1))))
    rows = made(seed)
    table = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
    chunk = substrings.Chunk(table, 13)
    heads, number = chunk.pieces()
    texts = [chunk.text(a, b + 13) for a, b in zip(chunk.low.tolist(), chunk.high.tolist(), strict=True)]
    first = {}
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    assert sorted(heads.tolist()) == sorted(first.values())
    assert [texts[heads[n]] for n in number] == texts
