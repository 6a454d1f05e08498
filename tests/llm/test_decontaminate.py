import random
import subprocess
import sys
from collections import Counter

import numpy as np

from cardloom.llm import decontaminate as d

SCHEMA = "doc_id long, text string, items string, item_id long"


def grams(words, k):
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(text, items):
    words, out = d.words_of(text), []
    for i, t in items:
        item = d.words_of(t)
        if not item:
            continue
        k = min(5, len(item))
        own, best = grams(item, k), None
        for at in range(max(1, len(words) - len(item) + 1)):
            window = grams(words[at : at + len(item)], k)
            s = d.similarity(own, window) if window else 0
            if s >= 0.8 and (best is None or s > best[0]):
                best = (s, at)
        if best:
            out.append((i, round(best[0], 9), best[1]))
    return sorted(out)


def made():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice(["é", "x", "yz", ""])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 8, 30, 60])))) for i in range(20)] + [(90, None), (91, "?!"), (92, "rep " * 20)]
    items.append((93, items[5][1]))
    texts = []
    for _ in range(200):
        w = [word() for _ in range(rng.choice([0, 2, 50, 400]))]
        if rng.random() < 0.7:
            part = d.words_of(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                if part:
                    part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = part
        texts.append(rng.choice([" ", "\n", ", "]).join(x.upper() if rng.random() < 0.2 else x for x in w))
    return items, [*texts, None, "", "rep " * 30_000, "rep " * 19]


def test_equals_brute_force(spark):
    items, texts = made()
    rows = [(i if i % 11 else None, t, "", 1) for i, t in enumerate(texts)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = d.find_items(docs, bench).collect()
    want = [(r[0], brute(r[1], items) if len(r[1] or "") < 9000 else None) for r in rows]
    long = [r for r in got if r["items"] and len(r["items"]) == 1 and r["items"][0].item_id == 92]
    assert {202, 203} <= {r.doc_id for r in long}
    have = sorted((str(r.doc_id), str(sorted((x.item_id, round(x.similarity, 9), x.word_from) for x in r["items"]))) for r in got if r not in long)
    assert have == sorted((str(i), str(w)) for i, w in want if w is not None and not (len(w) == 1 and w[0][0] == 92))
    assert all(r.contaminated == bool(r["items"]) for r in got)
    assert sum(r.contaminated for r in got) > 60


def test_slices_and_empty_tables(spark):
    bench = spark.createDataFrame([(i, f"item number {i} of the benchmark here") for i in range(9)], "item_id long, text string")
    assert len(list(d.benchmark_slices(bench, 80))) == 5
    docs = spark.createDataFrame([(1, "x item number 3 of the benchmark here y", "", 1)], SCHEMA)
    assert [x.item_id for x in d.find_items(docs, bench).first()["items"]] == [3]
    assert d.find_items(docs.limit(0), bench).count() == 0
    assert d.find_items(docs, bench.limit(0)).first().contaminated is False


def test_clean_rows_keep_their_columns(spark):
    bench = spark.createDataFrame([(1, "item number one of the benchmark here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x item number one of the benchmark here y", "own", True), (2, "clean", "own", False), (None, None, None, None)], "doc_id long, text string, items string, contaminated boolean")
    got = d.find_items(docs, bench, keep="clean")
    assert got.columns == docs.columns and sorted((str(r.doc_id), str(r["items"])) for r in got.collect()) == [("2", "own"), ("None", "None")]


def test_long_items_cut_short_in_foreign_text():
    rng = random.Random(7)
    for n in (200, 300, 400):
        for foreign in (lambda: f"z{rng.randrange(10**6)}", lambda: "z"):
            for before in (0, n):
                item = [f"w{rng.randrange(5000)}" for _ in range(n)]
                text = " ".join([foreign() for _ in range(before)] + item[: n * 9 // 10] + [foreign() for _ in range(n)])
                items = [(1, " ".join(item)), (2, " ".join(item[:60] * 3)), (3, "z " * 30)]
                want = brute(text, items)
                assert 1 in [i for i, _, _ in want]
                assert [(i, round(s, 9), at) for i, s, at, _ in d.Items(items).search(text)] == want


def test_slices_find_the_same(spark, monkeypatch):
    items, texts = made()
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts) if len(t or "") < 9000], SCHEMA)
    bench = spark.createDataFrame([(i, t) for i, t in items if i != 93], "item_id long, text string")
    plain = lambda frame: sorted((r.doc_id, r.contaminated, sorted(map(tuple, r["items"]))) for r in frame.collect())
    whole, clean = plain(d.find_items(docs, bench)), sorted(r.doc_id for r in d.find_items(docs, bench, keep="clean").collect())
    monkeypatch.setattr(d, "SLICE_BYTES", 400)
    assert plain(d.find_items(docs, bench)) == whole and sorted(r.doc_id for r in d.find_items(docs, bench, keep="clean").collect()) == clean


def test_multi_index_proposes_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    asked = np.concatenate([prints ^ np.array([sum(1 << int(b) for b in rng.permutation(64)[: rng.integers(0, 30)]) for _ in prints], dtype=np.uint64), rng.integers(0, 2**64, 50, dtype=np.uint64)])
    want = {(a, i) for a in range(len(asked)) for i in range(300) if int(asked[a] ^ prints[i]).bit_count() <= 23}
    assert set(zip(*(x.tolist() for x in d.MultiIndex(prints, 23).near(asked)), strict=True)) == want and len(want) > 200


def test_very_long_text_takes_little_memory():
    code = """
import resource, random
from cardloom.llm import decontaminate as d
rng = random.Random(1)
item = [f"w{rng.randrange(9999)}" for _ in range(60)]
items = d.Items([(1, " ".join(item)), (2, " ".join(item[:30] * 2))])
text = " ".join(item) + " z" * 3_000_000 + " " + " ".join(item) + " q" * 100
words = d.words_of(text)
items._hashes(words[:10])
a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
d.words_of = lambda t: words
got = items.search(text)
print(len(got), got[0][1], got[0][2], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)
"""
    n, s, at, grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert (int(n), float(s), int(at)) == (1, 1.0, 0) and int(grown) < 320


def test_passages_with_changed_words_are_found_as_by_brute_force():
    """Windows near the least similarity, also in texts that repeat the benchmark's own shingles."""
    rng, missed, wanted = random.Random(11), 0, 0
    items = [(i, " ".join(f"w{rng.randrange(700)}" for _ in range(rng.choice([30, 80, 250])))) for i in range(40)] + [(50, "z " * 30)]
    compiled = d.Items(items)
    for _ in range(150):
        i, t = rng.choice(items[:40])
        part = t.split()
        gone = rng.randrange(1 + len(part) // 9)
        part = part[: len(part) - gone]
        if rng.random() < 0.4 and len(part) > 60:
            part[rng.randrange(len(part))] = "y"
        text = " ".join([*("z" for _ in range(rng.choice([0, 90]))), *part, *("z" for _ in range(rng.choice([0, 300])))])
        want = brute(text, items)
        got = [(k, round(s, 9), at) for k, s, at, _ in compiled.search(text)]
        wanted += len(want)
        missed += len(set(want) - set(got))
        assert set(k for k, *_ in got) <= set(k for k, *_ in want)
    assert wanted > 100 and missed == 0
