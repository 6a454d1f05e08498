import random

import corpus_pipeline
from cardloom.llm import pii


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("uvwxyz") + rng.choice(["", "q", "r"])
    base = [" ".join(word() for _ in range(rng.choice([30, 120]))) for _ in range(120)]
    item = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i, text in enumerate(base):
        toxic = i % 6 == 0
        if toxic:
            text = f"vile {text} gross vile"
        rows.append((i, text, "en", f"src{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(200 + i, base[i], "en", "src1") for i in (1, 2, 3)]  # exact copies
    rows += [(300, base[5] + " end", "en", "src2"), (301, f"{base[7]} {item} {base[8]}", "en", None)]
    rows += [(302, f"{base[9][:90]} mail bob.99@mail1.example.com now", "de", "src0"), (303, None, None, None), (None, "nameless text here", "en", "src0")]
    docs = spark.createDataFrame([(d, t, la, s, len(t or "")) for d, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    every = {r[0] for r in rows}
    assert every - ids[0] == {i for i in range(120) if i % 6 == 0}
    assert ids[0] - ids[1] == {201, 202, 203, 300} & ids[0]
    assert ids[1] - ids[2] == {301} and ids[3] == ids[2]
    private = {r.doc_id: r for r in kept.collect()}
    assert "bob.99" not in private[302].text and "@" in private[302].text and private[302].n_chars == len(private[302].text)
    assert sum(r.text == dict((d, t) for d, t, *_ in rows)[r.doc_id] for r in private.values()) == len(private) - 1

    mixed = corpus_pipeline.mixing(spark, kept, str(tmp_path)).collect()
    taken = {}
    for r in mixed:
        assert len(r.text.split()) == r.words and r.text in (private[r.doc_id].text)
        taken[r.source] = taken.get(r.source, 0) + r.words
    assert all(abs(taken[r.source] - r.target) < 1.01 for r in mixed)
    places = sorted((r.shard, r.place) for r in mixed)
    assert places == [(s, p) for s in sorted({s for s, _ in places}) for p in range(1, sum(x == s for x, _ in places) + 1)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in mixed}


def test_kinds_have_patterns():
    assert set(pii.KINDS) == set(pii.PATTERNS)
