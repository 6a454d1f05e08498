import itertools
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from cardloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, th long, cls string"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (a == b or len(a & b) >= 0.8 * len(a | b)) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    best = {}
    for (d, t), x in zip(rows, label, strict=True):
        best.setdefault(x, []).append((d is None, d or 0))
    return sorted(str(None if n else d) for n, d in (min(v) for v in best.values()))


def made(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 4, 5, 9, 60, 400]))]
        for _ in range(rng.choice([1, 1, 2, 12 if g == 7 else 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6]) if len(words) > 20 else 0):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            rows.append((n, rng.choice([" ", "\n"]).join(copy).replace("w1", rng.choice("wW") + "1")))
            n += 1
    return [*rows, (n, None), (None, rows[4][1]), (None, "only me here in this text"), (n + 1, "long " * 9000 + "x"), rows[9], rows[9], (None, "y " * 9000)]


def test_equals_brute_force(spark):
    for piece in (2048, 3):
        rows = made(piece)
        docs = spark.createDataFrame([(d, t, "en", 1, "x") for d, t in rows], SCHEMA)
        got = near_copies.first_of_copies(docs, piece=piece)
        assert got.columns == docs.columns
        assert sorted(str(r.doc_id) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert near_copies.first_of_copies(docs).count() == 0


def chain(rng, n, words, step):
    """Texts of which neighbours alone are near copies."""
    base = [f"c{rng.randrange(10**6)}" for _ in range(words + n * step)]
    return [" ".join(base[i * step : i * step + words]) for i in range(n)]


def test_balls_lose_no_link(spark, monkeypatch):
    """With small pieces every shard is hot: leaders of balls meet, and members where leaders can't tell."""
    monkeypatch.setattr(near_copies, "BALL", 0.15)
    rng = random.Random(5)
    texts = chain(rng, 25, 200, 3) + chain(rng, 10, 120, 9)
    base = [f"n{rng.randrange(10**6)}" for _ in range(300)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in near_copies.first_of_copies(docs, piece=4).collect()) == brute(rows)


def hot_pieces(n=2048):
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**32, 400, dtype=np.uint32))
    sets = [np.unique(np.concatenate([rng.permutation(base)[:-12], rng.integers(0, 2**32, 12, dtype=np.uint32)])) for _ in range(2 * n)]
    prints = [near_copies.fingerprint(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    return pa.table({"cls": pa.array(range(2 * n), pa.int64()), "own": [i % 2 for i in range(2 * n)], "fp": pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})


def test_two_hot_pieces_take_little_memory():
    code = "import resource; from tests.llm.test_near_copies import *; t = hot_pieces(); a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; u, v, sure = near_copies._confirm(t, 0.8, 24); print(len(u), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    links, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split())
    assert links == 4095 and grown < 150


@pytest.mark.parametrize("alike", [0.8, 0.84, 0.9])
def test_recall_near_the_least_similarity(spark, alike):
    """Pairs of texts, each of its own words; the stage must find nine in ten at least."""
    rng, rows = random.Random(int(alike * 100)), []
    for i in range(150):
        words = [f"p{rng.randrange(10**7)}" for _ in range(400)]
        gone = int(396 * (1 - alike) / (1 + alike))  # shingles that each loses at its own end
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([f"q{rng.randrange(10**7)}" for _ in range(gone)] + words[gone:]))]
    kept = near_copies.first_of_copies(spark.createDataFrame(rows, "doc_id long, text string")).count()
    pairs = len(rows) - len(brute(rows))
    assert pairs == 150 and len(rows) - kept >= 0.9 * pairs


def family(n, gone, seed=4):
    """Sets of 300 of which each has lost and gained ``gone`` at random."""
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**32, 300, dtype=np.uint32))
    sets = [np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**32, gone, dtype=np.uint32)])) for _ in range(n)]
    prints = np.array([near_copies.fingerprint(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets], dtype=np.uint64)
    return sets, prints.view(np.int64)


def test_many_sets_that_are_nearly_similar_enough_end_in_time():
    """Two pieces at a similarity of about 0.7, where no pair is linked and none can be skipped: microseconds a pair."""
    import time

    sets, prints = family(4096, 53)
    table = pa.table({"cls": pa.array(range(4096), pa.int64()), "own": [i % 2 for i in range(4096)], "fp": pa.array(prints), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})
    start = time.process_time()
    u, _, _ = near_copies._confirm(table, 0.8, 24)
    assert len(u) < 4096 and time.process_time() - start < 60


def test_similarities_are_exact(monkeypatch):
    monkeypatch.setattr(near_copies, "STEP_SHINGLES", 700)
    sets, prints = family(60, 30)
    sets += [sets[0][:0], sets[0][:0], sets[1][:200], sets[1]]
    prints = np.append(prints, prints[:4])
    piece = near_copies._Piece(pa.table({"cls": pa.array(range(64), pa.int64()), "fp": pa.array(prints), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())}))
    for one in (0, 1, 60, 62):
        others, alike = piece.alike(one, np.arange(64), 0.5)
        want = {}
        for i, other in enumerate(sets):
            both = len(np.intersect1d(sets[one], other))
            j = both / (len(sets[one]) + len(other) - both) if len(sets[one]) + len(other) else 1.0
            if j >= 0.5:
                want[i] = j
        assert dict(zip(others.tolist(), alike.tolist(), strict=True)) == pytest.approx(want)


def test_boilerplate_draws_no_texts_together(spark, monkeypatch):
    """A line that all texts share isn't a meeting place of texts that have enough else, and near copies are still found."""
    met = []
    links = near_copies._class_links
    monkeypatch.setattr(near_copies, "_class_links", lambda members, *a: met.append(members) or links(members, *a))
    rng, rows = random.Random(3), []
    line = " ".join(f"licence{i}" for i in range(40))
    for i in range(60):
        words = [f"x{rng.randrange(10**7)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words) + " " + line), (2 * i + 1, " ".join([*words[:-3], "other", "end", "here"]) + " " + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.first_of_copies(docs, piece=20)
    assert sorted(str(r.doc_id) for r in kept.collect()) == brute(rows) and kept.count() == 60
    assert met[0].groupBy("key").count().where("count > 20").count() == 0
