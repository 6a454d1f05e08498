import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import incremental, postings, stats
from cardloom.sources.buckets import Buckets
from cardloom.streaming.maintain import apply_batch, maintain, read_changes


def model_watermark(log):
    floor, mark, out = None, None, []
    for mod, ok, clear in log:
        if clear:
            floor, mark = None, max(mark or mod, mod)
        elif not ok:
            floor = mod if floor is None else min(floor, mod)
        elif floor is None or floor > mod:
            mark = max(mark or mod, mod)
        out.append((mark, floor))
    return out


def test_watermarks_equal_the_model_and_never_overreach(spark):
    rng = random.Random(3)
    logs = {g: [(rng.randint(1, 30), rng.random() < 0.7, rng.random() < 0.1) for _ in range(25)] for g in range(8)}
    rows = [(g, i, m, ok, clear) for g, log in logs.items() for i, (m, ok, clear) in enumerate(log)]
    frame = spark.createDataFrame(rows, "g long, seq long, col_mod long, success boolean, clear boolean")
    got = {}
    for r in incremental.watermarks(frame, "g").orderBy("g", "seq").collect():
        got.setdefault(r.g, []).append((r.watermark, r.floor))
    assert got == {g: model_watermark(log) for g, log in logs.items()}


def test_reconcile_and_drift(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "note_id long, hash string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "note_id long, hash string")
    assert sorted(map(tuple, incremental.reconcile(old, new).collect())) == [(2, "embed"), (3, "remove"), (4, "embed")]
    meta = {"ndim": 3, "col_mod": 7, "model_id": "m", "schema": 2}
    assert not incremental.drifted(meta, 7, "m", True, 2)
    for change in ({"ndim": None}, {"col_mod": 6}, {"model_id": "n"}, {"schema": 1}):
        assert incremental.drifted(meta | change, 7, "m", True, 2)
    assert not incremental.drifted(meta | {"schema": 1}, 7, "m", False, 2) and incremental.drifted(None, 7, None, False, 2)


def test_frequency_refresh_equals_recount(spark):
    rng = random.Random(4)
    rows = lambda: [(s, t) for s in range(20) for t in rng.sample("abcdefg", rng.randint(0, 5))]
    frame = lambda r: spark.createDataFrame(r, "seg_id long, term string")
    before, after = rows(), rows()
    count = lambda r: frame(r).groupBy("term").agg(F.count("*").alias("df"))
    got = incremental.refresh_frequency(count(before), frame(before), frame(after))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, count(after).collect()))


def test_recognition_gate_routes_and_pending(spark):
    rows = [(1, "ocr", "a", "long enough text here", 0.9), (1, "vlm", "a", "long enough text here", 0.9), (2, "asr", "b", "abcd", 0.5), (3, "ocr", "c", "abc", 0.9), (4, "ocr", "d", "fine text", 0.4)]
    got = incremental.route(spark.createDataFrame(rows, "note_id long, source string, ref string, text string, confidence double")).collect()
    assert [(r.outcome, r.lexical, r.vector) for r in got] == [("lexical_and_vector", True, True), ("lexical_and_vector", False, True), ("lexical", True, False), ("drop", False, False), ("drop", False, False)]
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "note_id long, ref string")
    done, gated = refs.where("note_id = 1"), refs.where("note_id = 2")
    assert [tuple(r) for r in incremental.pending(refs, done, gated).collect()] == [(3, "c")]
    read = incremental.sweep(refs, lambda batch: batch.assign(text="read " + batch.ref, confidence=1.0))
    assert sorted(r.text for r in read.collect()) == ["read a", "read b", "read c"]


def test_metrics(spark):
    returned = spark.createDataFrame([(0, 1, 1, True), (0, 2, 2, False), (0, 3, 3, False), (1, 9, 1, True)], "query_id long, note_id long, rank int, is_exact boolean")
    gold = spark.createDataFrame([(0, 2, 2), (0, 3, 1), (0, 7, 2)], "query_id long, note_id long, grade int")
    rows = {r.query_id: r for r in stats.ir_metrics(returned, gold, spark.range(3).withColumnRenamed("id", "query_id")).collect()}
    import math

    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    ideal = 2 + 2 / math.log2(3) + 1 / math.log2(4)
    assert (rows[0].recall_at_1, rows[0].recall_at_5, rows[0].mrr, rows[0].hit_at_k) == (0.0, 0.5, 0.5, 1.0) and abs(rows[0].ndcg_at_10 - dcg / ideal) < 1e-12
    assert rows[0].exact_tier_pure is False and rows[1].over_returned and not rows[2].over_returned and rows[2].recall_at_1 is None and rows[2].precision_at_k is None
    with pytest.raises(ValueError, match="unknown sections"):
        stats.sections(["nope"])


def test_stream_keeps_a_table_current(spark, tmp_path):
    notes = {1: "one", 2: "two", 3: "three"}
    current = lambda: spark.createDataFrame(list(notes.items()), "note_id long, text string")
    ddl = "note_id bigint, col_mod bigint, kind string, success boolean"
    changes = str(tmp_path / "changes")
    put = lambda rows: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(changes)
    table = Buckets(spark, str(tmp_path / "table"), ["note_id"], "note_id long, text string", 8)
    derive = lambda rows: rows.select("note_id", F.upper("text").alias("text"))
    marks = lambda: tuple(table.note()[x] for x in ("watermark", "floor"))

    def drain():
        query = maintain(read_changes(spark, changes), current, table, str(tmp_path / "check"), derive)
        assert query.awaitTermination(120)

    put([(1, 1, "Maintain", True), (2, 2, "Maintain", True), (9, 3, "Maintain", True)])
    drain()
    assert {r.note_id: r.text for r in table.read().collect()} == {1: "ONE", 2: "TWO"} and marks() == (3, None)
    notes[2] = "deux"
    put([(1, 4, "Maintain", True), (1, 5, "Remove", True), (2, 6, "Maintain", True), (3, 7, "AdvanceOnly", False)])
    drain()
    assert {r.note_id: r.text for r in table.read().collect()} == {2: "DEUX"} and marks() == (6, 7)
    put([(3, 8, "Maintain", True)])
    drain()
    assert {r.note_id for r in table.read().collect()} == {2, 3} and marks() == (6, 7)


def test_batches_survive_a_kill_and_spare_other_buckets(spark, tmp_path, monkeypatch):
    """A batch that dies before its manifest runs again to the same table; one that dies after it finds itself done."""
    rng = random.Random(8)
    notes = spark.createDataFrame([(i, f"n{i}") for i in range(60)], "note_id long, text string")
    ddl = "note_id bigint, col_mod bigint, kind string, success boolean"
    logs = [[(rng.randrange(70), 100 * b + i, rng.choice(["Maintain", "Maintain", "Remove", "AdvanceOnly"]), rng.random() < 0.9) for i in range(9)] for b in range(4)]
    derive = lambda rows: rows.select("note_id", F.lit("field").alias("source"), "text")
    carry = F.col("source") == "ocr"

    def fresh(name):
        table = Buckets(spark, str(tmp_path / name), ["note_id"], "note_id long, source string, text string", 16)
        table.write(notes.select("note_id", F.lit("ocr").alias("source"), F.lit("read").alias("text")))
        return table

    whole, broken = fresh("whole"), fresh("broken")
    held = {(i, "ocr"): "read" for i in range(60)}
    commit = Buckets._commit
    for number, log in enumerate(logs):
        rows = spark.createDataFrame(log, ddl)
        before = broken.manifest()["buckets"]
        apply_batch(whole, rows, number, notes, derive, carry)
        with monkeypatch.context() as m:
            m.setattr(Buckets, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                apply_batch(broken, rows, number, notes, derive, carry)
        assert broken.manifest()["buckets"] == before
        assert apply_batch(broken, rows, number, notes, derive, carry) == apply_batch(broken, rows, number, notes, derive, carry)
        touched = set(map(str, broken.touched(rows.where("kind <> 'AdvanceOnly'"))))
        after = broken.manifest()["buckets"]
        assert {b: x for b, x in before.items() if b not in touched} == {b: x for b, x in after.items() if b not in touched}
        for note, kind in {n: k for n, _, k, _ in log if k != "AdvanceOnly"}.items():
            if kind == "Maintain" and note < 60:
                held[note, "field"] = f"n{note}"
            else:
                held.pop((note, "ocr"), None)
                held.pop((note, "field"), None)
        rows_of = lambda t: {(r.note_id, r.source): r.text for r in t.read().collect()}
        assert rows_of(broken) == rows_of(whole) == held
    assert broken.note() == whole.note() and commit is Buckets._commit
    assert broken.vacuum(1) > 0 and rows_of(broken) == held and broken.vacuum(1) == 0


def model_postings(texts):
    return sorted({(t.lower()[i : i + 3], s) for s, t in texts.items() for i in range(len(t) - 2)})


def test_postings_follow_changes_and_fold(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcD", k=rng.randrange(0, 9)))
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "seg_id long, text string")
    rows = lambda held: sorted(map(tuple, held.read().collect()))
    now = {s: word() for s in range(30)}
    held = postings.store(spark, str(tmp_path / "p"), 8)
    postings.build(held, frame(now))
    assert rows(held) == model_postings(now)
    for step in range(5):
        ids = rng.sample(range(40), 8)
        before = {s: now[s] for s in ids if s in now}
        after = {s: word() for s in ids if rng.random() < 0.7}
        postings.update(held, frame(before), frame(after), {"step": step}, most=2)
        now = {s: t for s, t in now.items() if s not in ids} | after
        assert rows(held) == model_postings(now) and held.note()["step"] == step
        assert all(len(x["layers"]) <= 2 for x in held.manifest()["buckets"].values())
    held.compact()
    assert rows(held) == model_postings(now) and not any(x["layers"] for x in held.manifest()["buckets"].values())
    assert rows(postings.store(spark, str(tmp_path / "p"), 99)) == model_postings(now) and held.n == 8
    bank = spark.createDataFrame([(1, "abcd"), (2, "zzz")], "query_id long, text string")
    want = [x for x in model_postings(now) if x[0] in ("abc", "bcd")]
    assert sorted(map(tuple, postings.lookup(held, bank).collect())) == want
    assert len(held.touched(bank.select(F.lit("abc").alias("term")))) == 1


def test_an_empty_store_has_no_rows(spark, tmp_path):
    held = postings.store(spark, str(tmp_path / "none"))
    assert held.read().count() == 0 and held.version() == -1 and held.compact() == -1 and held.vacuum() == 0
    postings.build(held, spark.createDataFrame([], "seg_id long, text string"))
    assert held.read().count() == 0 and held.version() == 0
    with pytest.raises(ValueError, match="touched"):
        held.rewrite([held.touched(spark.createDataFrame([("abc",)], "term string"))[0] + 1], spark.createDataFrame([("abc", 1)], held.schema))


def test_two_writers_of_a_version(spark, tmp_path):
    one, two = (postings.store(spark, str(tmp_path / "p")) for _ in range(2))
    two.version = lambda: -1  # it looked before the other wrote
    postings.build(one, spark.createDataFrame([(1, "abc")], "seg_id long, text string"))
    with pytest.raises(RuntimeError, match="another writer"):
        two._commit({}, None)
    assert [tuple(r) for r in one.read().collect()] == [("abc", 1)]


def test_postings_are_lists_of_bounded_length(spark, tmp_path):
    ids = [*range(-3, 400), 65_535, 65_536, 65_537, (1 << 40) + 5]
    texts = {s: "abc" if s % 2 else "abcd" for s in ids}
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "seg_id long, text string")
    held = postings.store(spark, str(tmp_path / "p"), 4)
    postings.build(held, frame(texts).coalesce(1))
    lists = {(r.term, r.high): len(r.lows) for r in held.lists().collect() if r.lows}
    assert lists == {("abc", -1): 3, ("abc", 0): 401, ("abc", 1): 2, ("abc", 1 << 24): 1, ("bcd", -1): 1, ("bcd", 0): 200, ("bcd", 1): 1}
    postings.update(held, frame({0: "abcd", 1: "abc", 65_537: "abc"}), frame({1: "abcx", 70_000: "bcd"}))
    texts = {s: t for s, t in texts.items() if s not in (0, 65_537)} | {1: "abcx", 70_000: "bcd"}
    assert sorted(map(tuple, held.read().collect())) == model_postings(texts)
    for r in held.totals().collect():
        own = [s for t, s in model_postings(texts) if t == r.term]
        assert (r.df, r.first_seg, r.last_seg, r.seg_sum) == (len(own), min(own), max(own), sum(own))
    found = {r.term: r.df for r in held.frequency(spark.createDataFrame([("bcx",), ("bcd",), ("zzz",)], "term string")).collect()}
    assert found == {"bcx": 1, "bcd": 202}
