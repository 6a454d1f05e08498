import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.functions import text
from cardloom.operators import calibrate, fuse, fuzzy, knn, overlap, positions, tags, vector_join
from cardloom.plans import search


def segments(spark, rows):
    return spark.createDataFrame([(i, n, s, r, t) for i, (n, s, r, t) in enumerate(rows)], "seg_id long, note_id long, source string, ref string, text string")


def bank(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def model_rrf(rankings, weights, k=60, priority=("exact",)):
    scores, parts = {}, {}
    for signal in sorted(rankings):
        w = weights.get(signal, 1.0)
        w = w if math.isfinite(w) else 1.0
        seen = set()
        for at, note in enumerate(rankings[signal], 1):
            if note not in seen:
                seen.add(note)
                scores[note] = scores.get(note, 0.0) + w / (k + at)
                parts.setdefault(note, []).append((at, signal))
    tier = lambda n: 0 if any(s in priority for _, s in parts[n]) else 1
    return [(n, scores[n], sorted(parts[n])) for n in sorted(scores, key=lambda n: (tier(n), -scores[n], n))]


def test_rrf_equals_the_model_bit_for_bit(spark):
    rng = random.Random(5)
    cases = []
    for q in range(40):
        names = rng.sample(["text", "image", "tag", "exact", "fuzzy"], rng.randint(0, 5))
        cases.append((q, {s: [rng.randint(1, 6) for _ in range(rng.randint(0, 7))] for s in names}))
    weights = {"text": 0.0, "image": float("nan"), "tag": -1.5, "fuzzy": 0.5, "exact": float("inf")}
    rows = [(q, s, n, at) for q, r in cases for s, ids in r.items() for at, n in enumerate(ids, 1)]
    rng.shuffle(rows)
    got = {}
    for r in fuse.rrf(spark.createDataFrame(rows, "query_id long, signal string, note_id long, rank long"), weights).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.note_id, r.score, [(s["rank"], s["signal"]) for s in r.signals]))
    for q, r in cases:
        assert got.get(q, []) == model_rrf(r, weights)


def model_prune(terms, df, policy):
    present = sorted((d, g) for g in terms if (d := df.get(g, 0)) > 0)
    floor = min(max(policy.typo_floor, 2), len(present))
    most, kept, total = max(policy.max_terms, floor), [], 0
    for d, g in present:
        kept.append(g)
        total += d
        if len(kept) >= most or len(kept) >= floor and policy.cost_per_term * len(kept) + policy.cost_per_df * total >= policy.cost_budget:
            break
    return sorted([*kept, *(g for g in terms if not df.get(g, 0))])


@pytest.mark.parametrize("policy", [fuzzy.PrunePolicy(), fuzzy.PrunePolicy(typo_floor=1), fuzzy.PrunePolicy(cost_budget=40.0), fuzzy.PrunePolicy(2, 1000.0, 4), fuzzy.PrunePolicy(3, 20.0, 12, 5.0, 0.5)])
def test_prune_equals_the_model(spark, policy):
    rng = random.Random(2)
    df = {f"t{i:02}": rng.choice([1, 2, 3, 5, 9, 30]) for i in range(30)}
    queries = {q: rng.sample([*df, "a", "b"], rng.randint(1, 20)) for q in range(12)}
    terms = spark.createDataFrame([(q, g) for q, gs in queries.items() for g in gs], "query_id long, term string")
    got = {}
    for r in fuzzy.prune(terms, spark.createDataFrame(list(df.items()), "term string, df long"), policy).collect():
        got.setdefault(r.query_id, []).append(r.term)
    assert {q: sorted(g) for q, g in got.items()} == {q: model_prune(g, df, policy) for q, g in queries.items()}


def test_fuzzy_typos_scope_hidden_and_excludes(spark):
    segs = segments(spark, [(1, "field", "A", "The protein folds"), (1, "field", "B", "protein protein"), (2, "field", "A", "Protean forms"), (3, "vlm", "A", "protein hidden"), (4, "field", "A", "unrelated")])
    got = fuzzy.fuzzy(bank(spark, "protien", "pr", "zzzzzz", "pro"), segs, 10).collect()
    by = {q: [(r.note_id, r.seg_id) for r in got if r.query_id == q] for q in range(4)}
    assert by[0][0][0] in (1, 2) and {n for n, _ in by[0]} == {1, 2} and by[1] == [] and by[2] == []
    assert by[3] == [(1, 0), (2, 2)]
    none = spark.createDataFrame([], "note_id long")
    assert fuzzy.fuzzy(bank(spark, "protein"), segs, 10, scope=none).count() == 0
    out = spark.createDataFrame([(0, 1)], "query_id long, note_id long")
    assert [r.note_id for r in fuzzy.fuzzy(bank(spark, "protein"), segs, 1, exclude=out).collect()] == [2]
    assert fuzzy.fuzzy(bank(spark, "protein"), segs, 0).count() == 0


def test_batch_equals_singles(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    segs = segments(spark, [(i // 2, "field", str(i), " ".join(rng.choices(words, k=6))) for i in range(40)])
    queries = ["alhpa beta", "gamma delta zeta", "epsilno"]
    whole = {(r.query_id, r.note_id, r["rank"]) for r in fuzzy.fuzzy(bank(spark, *queries), segs, 5).collect()}
    single = {(i, r.note_id, r["rank"]) for i, q in enumerate(queries) for r in fuzzy.fuzzy(bank(spark, q), segs, 5).collect()}
    assert whole == single


def test_lexical_signals_are_exact_and_the_rest(spark):
    segs = segments(spark, [(1, "field", "A", "one two three"), (2, "field", "A", "two three two three"), (3, "field", "A", "two thre")])
    b = bank(spark, "Two Three")
    near = fuzzy.fuzzy(b, segs, 10)
    got = sorted((r.signal, r["rank"], r.note_id) for r in fuzzy.lexical_signals(near, b, segs).collect())
    assert got == [("exact", 1, 2), ("exact", 2, 1), ("fuzzy", 1, 3)]
    exact = fuzzy.exact_of(near, b, segs)
    assert [r.note_id for r in exact.orderBy("rank").collect()] == [2, 1]
    assert [(r.note_id, r["rank"]) for r in fuzzy.without_exact(near, exact).collect()] == [(3, 1)]
    assert fuzzy.fuzzy_span("xé protein", "protien") == (4, 8)


def test_nearest_is_max_sim_with_excludes(spark):
    rng = random.Random(1)
    rows = [(i // 3, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    qs = [(q, [rng.gauss(0, 1) for _ in range(5)]) for q in range(4)]
    vecs, queries = spark.createDataFrame(rows, "note_id long, vec array<float>").repartition(5), spark.createDataFrame(qs, "query_id long, vec array<float>")
    import numpy as np

    f32 = lambda v: [float(np.float32(x)) for x in v]
    for skip in (None, [(0, 5), (1, 7)]):
        out = None if skip is None else spark.createDataFrame(skip, "query_id long, note_id long")
        got = [(r.query_id, r["rank"], r.note_id) for r in knn.nearest(queries, vecs, 7, exclude=out).collect()]
        want = []
        for q, v in qs:
            best = {}
            for n, w in rows:
                if (q, n) not in (skip or []):
                    best[n] = max(best.get(n, -9), sum(a * b for a, b in zip(f32(v), f32(w), strict=True)))
            want += [(q, i, n) for i, n in enumerate(sorted(best, key=lambda n: (-best[n], n))[:7], 1)]
        assert sorted(got) == sorted(want)


def test_tags_and_centroids(spark):
    notes = spark.createDataFrame([(1, ["a::b", "a"]), (2, ["a::c"]), (3, ["leech"]), (4, ["leech"]), (5, ["solo"]), (6, []), (7, [])], "note_id long, tags array<string>")
    members = tags.membership(notes)
    assert sorted(map(tuple, members.collect())) == [("a", 1), ("a", 2), ("a::b", 1), ("a::c", 2), ("leech", 3), ("leech", 4), ("solo", 5)]
    vecs = spark.createDataFrame([(n, 0, [1.0, 0.0] if n == 1 else [0.0, 1.0]) for n in range(1, 8)], "note_id long, item int, vec array<float>")
    got = tags.centroids(members, vecs, 7).collect()
    assert [(r.tag, r.members, r.embedded) for r in got] == [("a", 2, 2)] and abs(got[0].vec[0] - math.sqrt(0.5)) < 1e-12
    ranked = tags.tag_signal(spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vec array<float>"), tags.centroids(members, vecs, 7), members, vecs)
    assert [(r.note_id, r["rank"]) for r in ranked.orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_tag_signal_scores_every_member_of_a_large_tag(spark):
    n = 9000
    rows = [(i, 0, [math.cos(i / n), math.sin(i / n)]) for i in range(n)]
    vecs = spark.createDataFrame(rows, "note_id long, item int, vec array<float>").repartition(5)
    members = spark.createDataFrame([("hot", i) for i in range(n)] + [("rare", i) for i in range(3)], "tag string, note_id long")
    cents = spark.createDataFrame([("hot", [1.0, 0.0]), ("rare", [0.9, 0.1])], "tag string, vec array<double>")
    got = tags.tag_signal(spark.createDataFrame([(5, [1.0, 0.0]), (6, [-1.0, 0.0])], "query_id long, vec array<float>"), cents, members, vecs)
    assert [(r.query_id, r.note_id, r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(5, i, i + 1) for i in range(50)]


def test_calibration_needs_samples(spark):
    vecs = spark.createDataFrame([(i, 0, [math.cos(i), math.sin(i)]) for i in range(40)], "note_id long, item int, vec array<float>")
    few = calibrate.activation_stats(vecs, calibrate.sample_keys(vecs, 10)).first()
    assert few.n == 10 and few.mean is None
    row = calibrate.activation_stats(vecs, calibrate.sample_keys(vecs, 40)).first()
    assert row.n == 40 and 0.9 < row["mean"] <= 1.0
    hist = calibrate.duplicate_histogram(spark.createDataFrame([(1, 0.99), (2, 1.0), (3, -0.4), (4, None)], "note_id long, best double"))
    assert {r.bucket: r.n for r in hist.collect() if r.n} == {19: 2, 0: 1, None: 1}


def test_fused_search_end_to_end(spark):
    segs = segments(spark, [(1, "field", "A", "The mitochondria is a powerhouse"), (2, "field", "A", "mitochondrai typo"), (3, "field", "A", "something else")])
    vecs = spark.createDataFrame([("text", n, 0, v) for n, v in ((1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]))], "modality string, note_id long, item int, vec array<float>")
    b = bank(spark, "mitochondria", "is")
    queries = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vec array<float>")
    got = search.search(b, search.Index(segs, vecs), 10, queries).orderBy("query_id", "rank").collect()
    hits = [r for r in got if r.query_id == 0]
    assert [r.note_id for r in hits] == [1, 2, 3] and hits[0].substring.span.start == 4 and hits[0].semantic is None
    assert hits[1].semantic == 0.8 and [s.signal for s in hits[1].signals] == ["fuzzy", "text"]
    assert (hits[1].fuzzy.span.start, hits[1].fuzzy.span.end) == (0, 10) and hits[1].substring is None
    assert [r.note_id for r in got if r.query_id == 1] == [1]
    assert search.gate(["ab"], []) [0] is False and search.gate(["abc"], [])[0] and search.stale(1, 2) and not search.stale(1, 1)
    with pytest.raises(ValueError, match="needed"):
        search.gate([], [])


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        fuse.cross_space(None, None, None, mode="nope")
    assert F is not None


def vectors_in_clusters(rng, n, dims=6, around=8):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(around)]
    return [[c + rng.gauss(0, 0.05) for c in rng.choice(centres)] for _ in range(n)]


def best_by_brute(queries, rows, k, out=()):
    want = {}
    for q, v in queries:
        for note, w in rows:
            if v is not None and w is not None and (q, note) not in out:
                s = 0.0
                for a, b in zip(v, w, strict=True):
                    s += a * b
                want[q, note] = max(s, want.get((q, note), -9e9))
    ranked = {}
    for (q, note), s in sorted(want.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        ranked.setdefault(q, []).append((note, s))
    return {(q, note): s for q, found in ranked.items() for note, s in found[:k]}


@pytest.mark.parametrize("clusters", [1, 8])
def test_a_bank_of_any_size_is_answered_exactly(spark, monkeypatch, clusters):
    rng = random.Random(clusters)
    monkeypatch.setattr(vector_join, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(vector_join, "CHUNK_QUERIES", 9)
    monkeypatch.setattr(knn, "BLOCK", 5)
    rows = [(i // 2 if i % 3 else i, v) for i, v in enumerate(vectors_in_clusters(rng, 500, around=clusters))] + [(7, None)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    bank = [(i, v) for i, v in enumerate(vectors_in_clusters(rng, 40, around=clusters))] + [(99, None), (100, rows[0][1])]
    out = {(q, n) for q in range(5) for n in rng.sample(range(200), q)}
    frame = lambda r, a: spark.createDataFrame(r, f"{a} long, vec array<double>")
    queries, vecs, excluded = frame(bank, "query_id"), frame(rows, "note_id"), spark.createDataFrame(sorted(out), "query_id long, note_id long")
    got = {(r.query_id, r.note_id): r.sim for r in knn.nearest(queries, vecs, 7, exclude=excluded).collect()}
    assert got == best_by_brute(bank, rows, 7, out)
    near = {r.note_id: r.best for r in knn.best_in_bank(vecs, queries).collect()}
    want = {}
    for (q, n), s in best_by_brute(bank, rows, 10**6).items():
        if q != n:
            want[n] = max(s, want.get(n, -9e9))
    assert near == want
    monkeypatch.setattr(knn, "BLOCK", 4096)
    assert {(r.query_id, r.note_id): r.sim for r in knn.nearest(queries, vecs, 7, exclude=excluded).collect()} == got
    assert {r.note_id: r.best for r in knn.best_in_bank(vecs, queries).collect()} == near


def test_cells_that_can_not_pass_the_bar_are_not_asked(spark):
    rng = random.Random(3)
    rows = [(i, v) for i, v in enumerate(vectors_in_clusters(rng, 3000, dims=8, around=10))]
    vecs = spark.createDataFrame(rows, "note_id long, vec array<double>")
    queries = vecs.where("note_id % 60 = 0").withColumnRenamed("note_id", "query_id")
    cells, asked = vector_join.Cells(vecs), []
    found = vector_join.nearest_dealt(queries, vecs, 5, cells=cells, asked=asked)
    assert found.count() >= 5 * 50 and vector_join.pairs_scored(cells, asked, 50) < 0.35


def test_empty_banks_and_tables(spark):
    none = spark.createDataFrame([], "note_id long, vec array<double>")
    one = spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")
    assert vector_join.nearest_dealt(one, none, 3).count() == 0 and knn.nearest(one, none, 3).count() == 0
    assert vector_join.nearest_dealt(one.limit(0), one.withColumnRenamed("query_id", "note_id"), 3).count() == 0


def test_tag_signal_of_a_large_bank(spark, monkeypatch):
    rng = random.Random(4)
    notes = spark.createDataFrame([(i, [f"t{i % 7}::x", f"u{i % 3}"]) for i in range(200)], "note_id long, tags array<string>")
    vecs = spark.createDataFrame([(i, 0, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)], "note_id long, item int, vec array<double>")
    queries = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)], "query_id long, vec array<double>")
    members = tags.membership(notes)
    cents = tags.centroids(members, vecs, 200)
    few = sorted(map(tuple, tags.tag_signal(queries, cents, members, vecs, activation=0.0).collect()))
    monkeypatch.setattr(knn, "BLOCK", 5)
    monkeypatch.setattr(vector_join, "BLOCK_VECTORS", 11)
    many = sorted(map(tuple, tags.tag_signal(queries, cents, members, vecs, activation=0.0).collect()))
    assert many == few and len(few) > 500


def test_positions_and_samples(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 700)
    frame = spark.createDataFrame([(i,) for i in ids], "id long").repartition(9)
    placed = {r.id: r.position for r in positions.positions(frame, "id").collect()}
    assert placed == {v: i for i, v in enumerate(sorted(ids))}
    keys, state = sorted(ids), 0x9E3779B97F4A7C15
    for i in range(50):
        state = (state * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        j = i + (state >> 33) % (700 - i)
        keys[i], keys[j] = keys[j], keys[i]
    assert sorted(r.id for r in positions.drawn(frame, "id", 50).collect()) == sorted(keys[:50])
    assert positions.drawn_positions(3, 10) and sorted(positions.drawn_positions(3, 10)) == [0, 1, 2] and positions.drawn_positions(0, 5) == []
    rows = spark.createDataFrame([("a", i) for i in range(95)] + [("b", i) for i in range(10)], "tag string, note_id long")
    got = sorted(map(tuple, positions.strided(rows, "tag", "note_id", 10).collect()))
    assert got == [("a", i) for i in range(0, 95, 10)] + [("b", i) for i in range(10)]
    assert positions.positions(frame.limit(0), "id").count() == 0


def test_bank_meets_few_vectors_at_a_time():
    rng = np.random.default_rng(3)
    bank, own = rng.normal(0, 1, (4096, 4)), rng.normal(0, 1, (1500, 4))
    own[7] = 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(own.tolist())], names=["note_id", "vec"])
    out = list(knn.bank_batches(iter([batch]), np.arange(4096), bank, False))
    products = own @ bank.T
    products[np.arange(1500), np.arange(1500)] = -np.inf
    assert max(b.num_rows for b in out) * 4096 <= knn.PRODUCTS
    assert np.allclose(np.concatenate([b.column(1).to_numpy() for b in out]), products.max(axis=1), atol=1e-12)


@pytest.mark.parametrize("many", [False, True])
def test_few_short_queries_are_looked_for_one_by_one(spark, many):
    rng = random.Random(9)
    rows = [(rng.randrange(30), "field", f"{i:03}", "".join(rng.choice("abcdefghijklm İÄ漢") for _ in range(rng.choice([0, 1, 2, 9])))) for i in range(90)] + [(5, "field", "z", None)]
    asked = ["ab", "ab", "A", "漢", "zz", " b ", "", "abc"] + [a + b for a in "abcdefghi" for b in "abcdefghi"] * many
    short = [(q, t.strip().lower()) for q, t in enumerate(asked) if 1 <= len(t.strip()) <= 2]
    want = {}
    for q, t in short:
        firsts = {}
        for i, (note, _, ref, held) in enumerate(rows):
            if t in (held or "").lower():
                firsts[note] = min(firsts.get(note, (ref, i)), (ref, i))
        want |= {(q, note, firsts[note][1], at + 1): 1 for at, note in enumerate(sorted(firsts)[:3])}
    out = fuzzy.exact_fallback(bank(spark, *asked), segments(spark, rows), 3)
    assert {(r.query_id, r.note_id, r.seg_id, r.rank) for r in out.collect()} == set(want)
    assert ("zip_with" in out._jdf.queryExecution().optimizedPlan().toString()) == many


@pytest.mark.parametrize("postings", [False, True])
def test_overlaps_in_shards_and_blocks_equal_brute_force(spark, monkeypatch, postings):
    for name, value in {"SHARD_POSTINGS": 200, "BLOCK_QUERIES": 5, "WIDTH": 4, "STEP": 3}.items():
        monkeypatch.setattr(overlap, name, value)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcé", k=n))
    rows = [(s, s // 3, "vlm" if s % 7 == 0 else "field", str(s), word(rng.randrange(0, 14))) for s in range(150)]
    segs = spark.createDataFrame(rows, "seg_id long, note_id long, source string, ref string, text string")
    asked = [word(rng.randrange(2, 9)) for _ in range(17)]
    out = [(q, n) for q in range(17) for n in rng.sample(range(50), q % 4)]
    scope = spark.createDataFrame([(n,) for n in range(50) if n % 5], "note_id long")
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    held = {s: grams(t) for s, _, _, _, t in rows}
    want = []
    for q, t in enumerate(asked):
        df = {g: sum(g in x for x in held.values()) for g in grams(t)}
        kept = model_prune(list(df), df, fuzzy.PrunePolicy())
        best = {}
        for s, n, source, _, _ in rows:
            o = len(held[s] & set(kept))
            if o >= max(1, min(2, len(kept))) and source != "vlm" and n % 5:
                best[n] = max(best.get(n, (0, 0)), (o, -s))
        left = sorted((-o, n, -s) for n, (o, s) in best.items())[: 4 + q % 4]
        left = [x for x in left if (q, x[1]) not in out][:4]
        want += [(q, n, s, -o, at) for at, (o, n, s) in enumerate(left, 1)]
    stored = text.trigram_rows(segs) if postings else None
    got = fuzzy.fuzzy(bank(spark, *asked), segs, 4, scope, spark.createDataFrame(out, "query_id long, note_id long"), postings=stored)
    assert sorted((r.query_id, r.note_id, r.seg_id, r.overlap, r["rank"]) for r in got.collect()) == sorted(want)


def test_no_row_is_made_per_query_and_segment(spark, monkeypatch):
    made = []
    ours = fuzzy.best_overlaps
    monkeypatch.setattr(fuzzy, "best_overlaps", lambda asked, held, *n: made.append(ours(asked, held, *n)) or made[-1])
    rows = [(s, s, "field", "a", f"the same words and number {s}") for s in range(400)]
    segs = spark.createDataFrame(rows, "seg_id long, note_id long, source string, ref string, text string")
    got = fuzzy.fuzzy(bank(spark, *["the same words"] * 100), segs, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Explode" not in plan.split("FlatMapCoGroups")[0] and got.count() == 300 and made[0].count() == 300


@pytest.mark.parametrize("least", [1 << 18, 40])
def test_early_notes_and_repeated_queries_equal_brute_force(spark, monkeypatch, least):
    for module, values in ((overlap, {"SHARD_POSTINGS": 300, "BLOCK_QUERIES": 5, "WIDTH": 64, "FIRST_WIDTH": 64, "STEP": 3, "LEAST_POSTINGS": least, "EARLY": 0.3}), (fuzzy, {"LEAST_POSTINGS": least, "EARLY": 0.3})):
        for name, value in values.items():
            monkeypatch.setattr(module, name, value)
    met = []
    ours = fuzzy.best_overlaps
    monkeypatch.setattr(fuzzy, "best_overlaps", lambda asked, held, *n: met.append(len(n)) or ours(asked, held, *n))
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcé", k=n))
    rows = [(s, rng.choice([7, s // 4 - 20]), "vlm" if s % 9 == 0 else "field", str(s), word(rng.randrange(0, 14))) for s in range(400)]  # a quarter in one note
    segs = spark.createDataFrame(rows, "seg_id long, note_id long, source string, ref string, text string")
    asked = [(f"q{i % 20}", word(rng.randrange(2, 8))) for i in range(26)] + [("q0", None), ("none", "xyz")]  # some queries have two texts
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    held = {s: grams(t) for s, _, _, _, t in rows}
    own = {q: set().union(*(grams(t or "") for p, t in asked if p == q)) for q, _ in asked}
    want = []
    for q, terms in own.items():
        df = {g: sum(g in x for x in held.values()) for g in terms}
        kept = model_prune(list(df), df, fuzzy.PrunePolicy())
        best = {}
        for s, n, source, _, _ in rows:
            if (o := len(held[s] & set(kept))) >= max(1, min(2, len(kept))) and source != "vlm":
                best[n] = max(best.get(n, (0, 0)), (o, -s))
        want += [(q, n, s, -o, at) for at, (o, n, s) in enumerate(sorted((-o, n, -s) for n, (o, s) in best.items())[:4], 1)]
    got = fuzzy.fuzzy(spark.createDataFrame(asked, "query_id string, text string"), segs, 4)
    assert sorted((r.query_id, r.note_id, r.seg_id, r.overlap, r["rank"]) for r in got.collect()) == sorted(want)
    assert met == [3 if least == 40 else 2]


def test_a_task_holds_some_segments_however_many_there_are():
    def peak(n):
        rng = random.Random(4)
        names = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(300)]
        tracemalloc.start()
        meeting = overlap.Meeting(["".join(rng.sample(names, 6)) for _ in range(500)], [1] * 500, [3] * 500)
        for low in range(0, n, 500):
            meeting.add(list(range(low, low + 500)), list(range(low, low + 500)), ["".join(rng.sample(names, 60)) for _ in range(500)])
        rows = sum(len(x[0]) for x in meeting.best())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 1500
        return most

    assert peak(120_000) < 1.2 * peak(40_000) < 60e6


def test_a_bank_of_queries_makes_no_row_per_term(spark):
    rows = [(s, s, "field", "a", f"the same words and number {s}") for s in range(50)]
    segs = spark.createDataFrame(rows, "seg_id long, note_id long, source string, ref string, text string")
    asked = fuzzy.pruned(bank(spark, *[f"the same words as in number {i}" for i in range(40)]), {"the": 50, "he ": 50, "sam": 49}, fuzzy.PrunePolicy())
    assert {(r.held, r.size, r.floor) for r in asked.collect()} == {("samhe the", 3, 2)}
    assert "Window" not in asked._jdf.queryExecution().optimizedPlan().toString()
    assert fuzzy.fuzzy(bank(spark, "the same words"), segs, 3).count() == 3


@pytest.mark.parametrize("most", [3, 1 << 21])
def test_coded_numbers_come_back(most):
    rng = random.Random(3)
    lists = [sorted(rng.sample(range(most), rng.randrange(0, 4 if most < 9 else 30))) for _ in range(200)] + [[0, most - 1], [most - 1], []]
    of, numbers = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([n for x in lists for n in x], dtype=np.int64)
    back = text.decoded(text.coded(of, numbers, len(lists)).to_pylist())
    assert (back[0] == of).all() and (back[1] == numbers).all()
