import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cardloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp long, component_id string"


def brute(rows, size=3, radius=2):
    prints = []
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                moved = True
    least = {}
    for x, (doc_id, _) in zip(label, rows, strict=True):
        if doc_id is not None:
            least[x] = min(least.get(x, doc_id), doc_id)
    return sorted(((d, f"{p:016x}", least.get(x)) for (d, _), p, x in zip(rows, prints, label, strict=True)), key=str)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "ÉPSILON", "zeta", "eta", "theta", "iota", "kappa"]
    rows, n = [], 0
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 40, 200]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(copy)))
            n += 1
    return [*rows, (n, None), (None, "alpha beta"), (None, None), rows[0], (n + 1, "long " * 5000), (n + 2, "a\x85b c d")]


@pytest.mark.parametrize("piece", [3, 2048])
def test_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash.shard_tasks, "__defaults__", (piece,))
    rows = made(piece)
    docs = spark.createDataFrame([(d, t, "en", 1, "x") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_chain_of_links_is_one_component(spark):
    values = [0b11 << (2 * i) for i in range(20)]
    chain, at = [0], 0
    for v in values:
        at ^= v
        chain.append(at)
    classes = spark.createDataFrame([(v,) for v in chain], "fp long")
    from cardloom.llm.components import components

    roots = components(simhash.fingerprint_links(classes, 2), "u", "v").collect()
    assert len(roots) == 21 and {r.root for r in roots} == {0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0


def test_bk_tree_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64))
    found = {(int(q), v) for near, v in simhash.BKTree(values).search(values, 2) for q in near}
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if int(a ^ b).bit_count() <= 2}
    assert found == want
