import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from cardloom.llm.common import WORD_RE
from cardloom.llm.periodic_runs import _search, digests, find_runs, name_levels, periodic_runs, planted

SCHEMA = "doc_id long, text string, runs string, n_words int, start long"


def brute(words, exponent=4, shortest=6):
    """All runs, period by period and word by word."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(shortest, exponent * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made(rng):
    kind = rng.randrange(5)
    size = rng.choice([1, 2, 3, 8])
    words = [rng.choice("abcdefgh"[:size]) for _ in range(rng.choice([0, 1, 5, 6, 7, 40, 150]))]
    if kind > 1:
        for _ in range(rng.randrange(1, 4)):
            part = [rng.choice("abxyz") for _ in range(rng.randrange(1, 12))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (part * rng.randrange(2, 9))[: rng.randrange(1, 90)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    docs = [made(rng) for _ in range(1500)] + [["a"] * 300, ["a", "b"] * 200, list("abaab" * 40) + list("ab" * 30)]
    for words, (runs, text) in zip(docs, _search(docs, 4, 6), strict=True):
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert text.split() == collapsed(words, want)


def test_other_limits():
    rng = random.Random(6)
    docs = [made(rng) for _ in range(300)]
    for words, (runs, _) in zip(docs, _search(docs, 5, 12), strict=True):
        assert [(r["start"], r["length"], r["period"]) for r in runs] == brute(words, 5, 12)


def test_levels_end_where_no_name_repeats():
    assert len(name_levels(np.arange(1000, dtype=np.int32), 1000)) == 1
    assert len(name_levels(np.zeros(1000, dtype=np.int32), 1000)) == 10
    start, end, period = find_runs(np.zeros(100_000, dtype=np.int32), 100_000)
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [100_000], [1])


def digest(doc_id, text):
    """The row of the query by brute force."""
    words = planted(doc_id, text)
    runs = brute(words)
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapsed(words, runs))))


def test_rows_of_all_kinds(spark):
    rng = random.Random(7)
    texts = [" ".join(made(rng)) for _ in range(120)] + [None, "", " \n\t", "one", "é　è " * 9, "x\x00y " * 6, "la " * 3_000, "b b b b b b", "B b B b B b B b"]
    rows = [(None if i % 40 == 39 else i, t, "own", 1, 2) for i, t in enumerate(texts)]
    rows += rows[:5]
    got = digests(periodic_runs(spark.createDataFrame(rows, SCHEMA), words_of=planted)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digest(d, t) for d, t, *_ in rows), key=str)
    plain = periodic_runs(spark.createDataFrame(rows, SCHEMA)).select("n_words", F.size("runs").alias("n")).collect()
    assert sorted(map(tuple, plain)) == sorted((len(words), len(brute(words))) for words in (WORD_RE.findall(t or "") for _, t, *_ in rows))


def test_empty_table(spark):
    assert digests(periodic_runs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_planting_follows_its_rule():
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert ids
    words = [f"w{i}" for i in range(50)]
    for i in ids:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert planted(i, " ".join(words)) == [words[j] if j < a else words[a + (j - a) % p] for j in range(50)]
    assert planted(next(i for i in range(400) if i not in ids), "a b") == ["a", "b"] and planted(None, "a") == ["a"]
