import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.functions import hashing, text, vectors


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("{{c1::a {{c2::b}} c::hint}}", "a b c"),
        ("outer {{c2::inner}} x::hint", "outer inner x::hint"),
        ("a<br>b<div>c</div>", "a b c"),
        ("x &amp; y&nbsp;z", "x & y z"),
        ("&amp;lt;b&amp;gt; &copy; &#8364;&hellip;", "&lt;b&gt; © €…"),
        ("[$]x[/$] [$$]y[/$$] $$z$$ \\[w\\] [LaTeX]v", "x y z w v"),
        ("[sound:a.mp3] hi [latex]x[/latex] \\(y\\)", "hi x y"),
        ("<style>p{}</style><b>bold</b><!-- gone -->", "bold"),
        ("plain  text\n here ", "plain text here"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_for_embedding(spark, raw, want):
    assert one(spark, text.normalize_for_embedding("v"), raw) == want


def test_trigrams_windows_and_short_texts(spark):
    assert one(spark, text.trigrams("v"), "AbCd") == ["abc", "bcd"]
    assert one(spark, text.trigrams("v"), "ab") == []
    assert one(spark, text.trigrams("v"), "\U0001f600éx") == ["\U0001f600éx"]
    rows = text.trigram_rows(spark.createDataFrame([(1, "aaaab"), (2, "éab"), (3, None)], "seg_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == [(1, "aaa"), (1, "aab"), (2, "éab")]


def test_media_references(spark):
    html = '<img src="a/b.png"><IMG data-src="x.png"><img src="http://h/c.png"><img src=\'d&amp;e.jpg\'><img src="a/b.png">'
    assert one(spark, text.image_refs("v"), html) == ["b.png", "d&e.jpg"]
    assert one(spark, text.sound_refs("v"), "[sound:http://x/y.mp3][sound:a.mp3] [SOUND:q/b.ogg][sound:a.mp3]") == ["a.mp3", "b.ogg"]
    assert one(spark, text.is_blank("v"), " <br>&nbsp;") is True
    assert one(spark, text.is_blank("v"), "<img src=a.png>") is False


def test_byte_span_counts_utf8(spark):
    row = spark.createDataFrame([("\U0001f600 Héllo", "héL"), ("abc", "zzz"), ("İab", "ab")], "t string, n string").select(text.byte_span("t", "n").alias("s")).collect()
    assert (row[0].s.start, row[0].s.end) == (5, 9) and row[1].s is None and (row[2].s.start, row[2].s.end) == (2, 4)


@pytest.mark.parametrize(("value", "needle"), [("İİx😀Straẞe", "straß"), ("aİb", "İ"), ("ŞİŞLİ", "şli"), ("ΑΣ İ ΑΣ", "ας"), ("x" * 40 + "İé" * 30 + "END", "end"), ("İ", "i")])
def test_spans_where_lower_case_is_longer(spark, value, needle):
    span = spark.createDataFrame([(value, needle)], "t string, n string").select(text.byte_span("t", "n").alias("s")).first().s
    low, at = [(c.lower(), i) for i, c in enumerate(value)], value.lower().find(needle.lower())
    owner = [i for c, i in low for _ in c]
    first, last = owner[at], owner[at + len(needle.lower()) - 1]
    assert (span.start, span.end) == (len(value[:first].encode()), len(value[: last + 1].encode()))


def test_references_are_the_standards(spark):
    import html
    import random
    from html.entities import html5

    rng = random.Random(6)
    names = [*html5, "#65;", "#x41;", "#X1F600;", "#128;", "#150", "#0;", "#99999999;", "#xD800;", "#1114112;", "#39;", "nothing;", "ampx", "copyx;", "#", "#x", "&", "amp;lt;"]
    rows = ["&" + n for n in names] + ["".join(rng.choice(["&" + rng.choice(names), " a", ";", "x"]) for _ in range(12)) for _ in range(300)] + ["plain", "", "&"]
    got = spark.createDataFrame(list(enumerate(rows)), "i long, v string").select("i", text.decode_references("v").alias("t")).collect()
    assert {r.i: r.t for r in got} == dict(enumerate(map(html.unescape, rows)))


def test_field_substring_takes_the_first_by_name(spark):
    fields = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(v).alias("value")) for i, (n, v) in enumerate([("Z", "find me"), ("A", "also Find")])))
    got = spark.range(1).select(text.field_substring(fields, F.lit("find")).alias("r")).first().r
    assert (got.name, got.span.start, got.span.end) == ("A", 5, 9)


def test_replacements(spark):
    assert one(spark, text.replace_literal("v", "a.b", "$1\\", True), "xA.By") == "x$1\\y"
    assert one(spark, text.replace_regex("v", "(a)(b)", r"\2\g<1>"), "ab") == "ba"
    assert one(spark, text.snippet("v", F.lit("needle")), "x" * 50 + "needle" + "y" * 50) == "…" + "x" * 30 + "needle" + "y" * 30 + "…"


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.png", "a.png", "apng"), ("a?c", "abc", "ac"), ("[a-c]x", "bx", "dx"), ("[!a]x", "bx", "ax"), ("a+b*", "a+bc", "aab")])
def test_globs(spark, glob, yes, no):
    column = F.col("v").rlike(text.glob_pattern(glob))
    assert one(spark, column, yes) and not one(spark, column, no)


def test_vectors_and_hashes(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(vectors.l2_normalize("a"), vectors.l2_normalize("z"), vectors.inner_product("a", "a")).first()
    assert row[0] == [0.6, 0.8] and row[1] == [0.0, 0.0] and row[2] == 25.0
    rounded = spark.createDataFrame([(0.0005,), (0.0015,), (0.12349,)], "x double").select(vectors.round3("x")).collect()
    assert [r[0] for r in rounded] == [0.0, 0.002, 0.123]
    assert hashing.blake2b8("") == "e4a6a0577479b2b4"
    v = vectors.synthetic_vector("text", 16)
    assert v == vectors.synthetic_vector("text", 16) != vectors.synthetic_vector("texu", 16) and abs(sum(x * x for x in v) - 1) < 1e-6
    assert one(spark, hashing.tag_key("v"), "a::b") >= 0


def test_batch_hash_is_the_loops():
    data = [bytes(i % 251 for i in range(n)) for n in [0, 1, 5, *range(60), 3000, 900]]
    assert vectors.fnv1a_batch(data) == [vectors.fnv1a(x) for x in data] and vectors.fnv1a_batch([]) == []


def test_long_texts_are_hashed_without_a_loop_over_bytes(monkeypatch):
    rng = random.Random(4)
    data = [rng.randbytes(n) for n in (70, 0, 3, 64, 200, 1, 65, 32, 33, 500)]
    want = [vectors.fnv1a(x) for x in data]
    monkeypatch.setattr(vectors, "HASHED", 64, raising=False)
    monkeypatch.setattr(vectors, "fnv1a", lambda *a: pytest.fail("byte by byte"))
    assert vectors.fnv1a_batch(data) == want
    for dims in (1, 7, 32, 200):
        assert vectors.synthetic_vectors(want, dims).tolist() == [vectors.synthetic_vector("", dims, s) for s in want]


def test_trigrams_come_in_batches_of_bounded_size():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ÄİéßΣ漢字😀") for _ in range(rng.choice([0, 1, 2, 3, 500, 9_000]))) for _ in range(600)] + [None, "xyz" * 200_000 + "q漢"]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["seg_id", "text"])
    for terms in (None, ["abc", "ab ", "yzq", "zq漢", "漢字😀", "nul"]):
        want = set()
        for i, x in enumerate(texts):
            low = unicodedata.normalize("NFC", x or "").lower()
            want |= {(i, "".join(w)) for w in zip(low, low[1:], low[2:], strict=False) if terms is None or "".join(w) in terms}
        asked = None if terms is None else np.array([[ord(c) for c in x] for x in terms], dtype=np.uint32)
        out = list(text.trigram_batches(iter([whole]), asked))
        got = [row for b in out for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        assert len(out) > 1 and max(b.num_rows for b in out) <= text.TRIGRAM_CHARS + 9_000


def test_spans_fold_no_character_by_itself(spark):
    texts = ["İİabİ漢 İ😀ẞx", "xİ", "İ", "plain İ end", "", None, "abc", "aİ" * 30]
    rows = [(t, n) for t in texts for n in ("i", "̇", "i̇a", "abi", "̇漢", "x", "İ", "end", "", None, "ai̇a", "😀ß")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, v string, n string").select("id", text.byte_span("v", "n").alias("span")).collect()
    for r in got:
        v, n = rows[r.id]
        want, needle = None, (n or "").strip(" ").lower()
        if v is not None and needle and (at := v.lower().find(needle)) >= 0:
            of = [i for i, c in enumerate(v) for _ in c.lower()]
            want = (len(v[: of[at]].encode()), len(v[: of[at + len(needle) - 1] + 1].encode()))
        assert (r.span and tuple(r.span)) == want, (v, n)
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(1, 0x110000).where("id not between 55296 and 57343").select(c.alias("c"))
    assert [r.c for r in points.where(F.length(F.lower("c")) != F.length("c")).collect()] == [text.LONGER]
    plan = spark.createDataFrame([("a", "b")], "v string, n string").select(text.byte_span("v", "n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
