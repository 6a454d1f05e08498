import random
import re
from itertools import permutations

from cardloom.llm import filter_audit
from cardloom.llm.filter_audit import audit, failure_masks

DOCS = "doc_id long, text string, lang string, part string, mask int, n int"
LABELS = "doc_id long, quality int, toxic int, lang string"


def fails(row, rows):
    doc_id, text = row[0], row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    out += "E" if doc_id is not None and any((o[1] or "") == text and o[0] is not None and o[0] < doc_id for o in rows) else ""
    return out


def brute(rows, labels):
    """Every order applied row by row."""
    out = []
    good, toxic = {d for d, q, *_ in labels if q == 1} - {None}, {d for d, _, t, *_ in labels if t == 1} - {None}
    judged = [(r[0], r[2] or "", fails(r, rows)) for r in rows]
    for part in sorted({p for _, p, _ in judged}):
        own, steps, share = [(d, f) for d, p, f in judged if p == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                redundant = sum(c in f for _, f in own) - len(gone)
                share[c] += len(gone)
                steps.append((c, (part, "".join(order), step, len(left), len(gone), redundant, sum(f == c for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))))
        out += [(*row, share[c]) for c, row in steps]
    return sorted(out)


def made():
    rng = random.Random(11)
    pool = [None, "", " \t", "A B C", "one two", "x" * 500, "#", "word " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "é" * 90 + " $", " ".join(f"v{i}" for i in range(210)) + " *"]
    rows = [(rng.randrange(90) if rng.random() < 0.95 else None, rng.choice(pool), rng.choice(["de", "en", None, ""]), "x", 1, 2) for _ in range(200)]
    rows += [(300 + i, "hot copy", "en", "x", 0, 0) for i in range(120)] + rows[:10]
    labels = [(rng.choice([*range(95), 300, 310, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "own") for _ in range(150)]
    return rows, labels


def test_equals_brute_force(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = audit(docs, spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_chains_that_are_passed_on_early_give_the_same(spark, monkeypatch):
    rows, _ = made()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    whole = sorted(map(str, failure_masks(docs).groupBy("doc_id", "part", "mask").sum("n").collect()))
    monkeypatch.setattr(filter_audit, "HELD_CHARS", 50)
    monkeypatch.setattr(filter_audit, "PARTITION_BYTES", 500)
    monkeypatch.setattr(filter_audit, "xxh64_intdigest", lambda x: len(x) % 3)  # fingerprints that collide
    assert sorted(map(str, failure_masks(docs).groupBy("doc_id", "part", "mask").sum("n").collect())) == whole


def test_copies_of_a_hot_text_stay_where_they_are_read(spark):
    chains = list(filter_audit._shorten(((i, "same", "en") for i in range(5000)), filter_audit.FILTERS))
    travelling = [row for _, row in chains if isinstance(row[0], str)]
    assert travelling == [("same", 0, 1, {"en": 1})] and len(chains) == 5000


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = audit(spark.createDataFrame([(1, None, None, "", 0, 0)], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}
