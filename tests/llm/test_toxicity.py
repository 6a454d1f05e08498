import random

import numpy as np

from cardloom.llm import toxicity as t

SCHEMA = "doc_id long, text string, p_toxic string, toxic string"


def made(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(rng.choice([5, 30, 200]))]
        toxic, low = rng.random() < 0.15, rng.random() < 0.3
        for _ in range(rng.randint(2, 4) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["vile", "gross", "hatefulness", "hateful", "hateform"]))
        if low:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        rows.append((i, " ".join(words), "", ""))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = made(900, 1)
    docs = spark.createDataFrame([*rows, (None, None, "", ""), (5000, "", "", ""), rows[3], (5001, "vile gross " + "word " * 40_000, "", "")], SCHEMA)
    known = t.label_columns(spark.createDataFrame([*labels[:600], (7, None, 1), (8, 1, None)], "doc_id long, quality int, toxic int"))
    got = t.classify(docs, t.fit(docs, known, t.CATEGORIES)).collect()
    assert len(got) == 904 and [f for f in got[0].asDict()] == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    by = {r.doc_id: r for r in got}
    wrong = [i for i, q, x in labels[600:] if by[i].toxic != bool(x)]
    assert len(wrong) <= 3
    assert sum((by[i].p_low_quality > 0.5) == bool(q) for i, q, _ in labels[600:]) <= 3
    chain = t.fit(docs, known, t.CATEGORIES)
    kept = t.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    assert not by[None].toxic and not by[5000].toxic and by[5001].toxic


def test_sample_bounds_and_single_class(spark):
    rows, labels = made(60, 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = t.label_columns(spark.createDataFrame([(i, q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int"))
    chain = t.fit(docs, known, t.CATEGORIES, sample=20)
    assert not any(r.toxic for r in t.classify(docs, chain).collect())
    empty = t.fit(docs, known.limit(0), t.CATEGORIES)
    assert not any(r.toxic for r in t.classify(docs, empty).collect())
    assert t.classify(docs.limit(0), chain).count() == 0


def test_one_long_text_leaves_no_class_empty(spark):
    rows, labels = made(300, 4)
    long = [(i, t_ + " word" * 3000 if i % 2 else t_, a, b) for i, t_, a, b in rows]
    known = t.label_columns(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    chain = t.fit(spark.createDataFrame(long, SCHEMA), known, t.CATEGORIES, sample_chars=40_000)
    assert all(m.names for m in chain.models[1:])
    tiny = t.fit(spark.createDataFrame(long, SCHEMA), known, t.CATEGORIES, sample_chars=1)
    assert len(tiny.models) == 2


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, (200, 2)).astype(float)
    texts = t.Encoded()
    for _ in range(200):
        texts.add({})
    chain = t.Chain(("a", "b"), texts, np.zeros((200, 8)), labels, styled=())
    assert [len(m.weights) for m in chain.models] == [0, 1]


def test_repeated_labels_follow_a_rule(spark):
    """Of labels that disagree the greatest holds, in whatever order they come."""
    rows, labels = made(120, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    frame = lambda some: t.label_columns(spark.createDataFrame(some, "doc_id long, quality int, toxic int"))
    both = [x for i, q, y in labels for x in ((i, q, y), (i, 1 - q, 1 - y))]
    scores = lambda some: sorted(map(tuple, t.classify(docs, t.fit(docs, frame(some), t.CATEGORIES)).collect()))
    assert scores(both) == scores(both[::-1]) == scores([(i, 0, 1) for i, _, _ in labels])
