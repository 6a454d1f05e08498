"""Registered queries over the test tables, with the SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import hashing, text, vectors
from cardloom.operators import calibrate, cards, filters, fuse, fuzzy, incremental, knn, mutate, positions, postings, stats, tags, vector_join
from cardloom.plans import search as plans
from cardloom.sources import notes as sources
from cardloom.sources import reference_tables as t
from cardloom.sources.buckets import Buckets
from cardloom.sources.files import checkpoint, scratch
from cardloom.streaming import maintain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Columns that SQL makes as 64-bit numbers.
_LONG = ("rank", "tag_rank", "at", "bucket", "ndim")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows and types."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        @wraps(function)
        def typed(spark: SparkSession, folder: str) -> DataFrame:
            out = function(spark, folder)
            return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if c in _LONG and kind == "int"})

        QUERIES[function.__name__] = typed
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- trigrams, fuzzy and exact search

_DOCS = "SELECT doc_id AS seg_id, doc_id AS note_id, 'field' AS source, text FROM documents"
_CONV = "SELECT conv_id * 1000 + turn AS seg_id, conv_id AS note_id, CASE WHEN role = 'system' THEN 'vlm' ELSE 'field' END AS source, text FROM conversations"
_BENCH = "SELECT item_id AS query_id, text FROM benchmark"


def _fuzzy_sql(bank: str, segments: str, k: int, scope: str = "true") -> str:
    return f"""bank AS ({bank}), seg AS ({segments}),
qc AS (SELECT query_id, string_split(lower(text), '') AS c FROM bank),
qt AS (SELECT DISTINCT query_id, c[i] || c[i + 1] || c[i + 2] AS term FROM (SELECT query_id, c, unnest(range(1, len(c) - 1)) AS i FROM qc)),
sc AS (SELECT seg_id, string_split(lower(text), '') AS c FROM seg),
post AS (SELECT DISTINCT seg_id, c[i] || c[i + 1] || c[i + 2] AS term FROM (SELECT seg_id, c, unnest(range(1, len(c) - 1)) AS i FROM sc)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
known AS (SELECT query_id, qt.term, coalesce(df, 0) AS df FROM qt LEFT JOIN df ON qt.term = df.term),
kept AS (SELECT query_id, term, df FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS r FROM known WHERE df > 0) WHERE r <= 6),
floors AS (SELECT query_id, least(2, count(*)) AS floor FROM (SELECT query_id, term FROM kept UNION ALL SELECT query_id, term FROM known WHERE df = 0) GROUP BY query_id),
met AS (SELECT query_id, seg_id, count(*) AS overlap FROM kept JOIN post ON kept.term = post.term GROUP BY query_id, seg_id),
good AS (SELECT met.query_id, met.seg_id, overlap, note_id FROM met JOIN floors ON met.query_id = floors.query_id JOIN seg ON met.seg_id = seg.seg_id WHERE overlap >= floor AND source <> 'vlm' AND {scope}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, note_id ORDER BY overlap DESC, seg_id) AS r FROM good) WHERE r = 1),
fuzzy AS (SELECT * FROM (SELECT query_id, note_id, seg_id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, note_id) AS rank FROM best) WHERE rank <= {k}),
exact AS (SELECT query_id, note_id, seg_id, tf, row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, note_id) AS rank FROM (
  SELECT f.query_id, f.note_id, f.seg_id, CAST((length(lower(s.text)) - length(replace(lower(s.text), lower(trim(b.text)), ''))) // length(lower(trim(b.text))) AS DOUBLE) / length(s.text) AS tf
  FROM fuzzy f JOIN seg s ON f.seg_id = s.seg_id JOIN bank b ON f.query_id = b.query_id WHERE contains(lower(s.text), lower(trim(b.text))) AND trim(b.text) <> '')),
rest AS (SELECT query_id, note_id, seg_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fuzzy f WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = f.query_id AND e.note_id = f.note_id))"""


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, c[i] || c[i + 1] || c[i + 2] AS term FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT doc_id, string_split(lower(text), '') AS c FROM documents))) GROUP BY term")
def trigram_df(spark, d):
    return fuzzy.document_frequency(text.trigram_rows(t.document_segments(spark, d)))


@query("SELECT conv_id * 1000 + turn AS seg_id, count(*) AS windows, count(DISTINCT term) AS terms, min(term) AS first_term FROM (SELECT conv_id, turn, c[i] || c[i + 1] || c[i + 2] AS term FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT conv_id, turn, string_split(lower(text), '') AS c FROM conversations))) GROUP BY ALL")
def trigram_postings_top(spark, d):
    grams = t.conversation_segments(spark, d).select("seg_id", text.trigrams("text").alias("g")).where("size(g) > 0")
    return grams.select("seg_id", F.size("g").cast("long").alias("windows"), F.size(F.array_distinct("g")).cast("long").alias("terms"), F.array_min("g").alias("first_term"))


_FUZZY_COLUMNS = ["query_id", "note_id", "overlap", "rank"]


@query(f"WITH {_fuzzy_sql(_BENCH, _DOCS, 20)} SELECT query_id, note_id, overlap, rank FROM fuzzy")
def fuzzy_benchmark(spark, d):
    return fuzzy.fuzzy(t.benchmark_bank(spark, d), t.document_segments(spark, d), 20).select(_FUZZY_COLUMNS)


@query(f"WITH {_fuzzy_sql(_BENCH, _DOCS, 20, 'note_id IN (SELECT doc_id FROM documents WHERE lang = $$en$$)')} SELECT query_id, note_id, overlap, rank FROM fuzzy")
def fuzzy_scoped(spark, d):
    scope = filters.scope_of(t.document_notes(spark, d), deck="en")
    return fuzzy.fuzzy(t.benchmark_bank(spark, d), t.document_segments(spark, d), 20, scope).select(_FUZZY_COLUMNS)


_TURNS = "SELECT conv_id AS query_id, text FROM conversations WHERE turn = 0"


@query(f"WITH {_fuzzy_sql(_TURNS, _CONV, 10)} SELECT query_id, note_id, seg_id, overlap, rank FROM fuzzy")
def fuzzy_multisegment(spark, d):
    bank = t.table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    return fuzzy.fuzzy(bank, t.conversation_segments(spark, d), 10).select("query_id", "note_id", "seg_id", "overlap", "rank")


def _benchmark_signals(spark, d, k=20):
    bank, segments = t.benchmark_bank(spark, d), t.document_segments(spark, d)
    near = checkpoint(fuzzy.fuzzy(bank, segments, k))
    exact = fuzzy.exact_of(near, bank, segments)
    return bank, segments, exact, fuzzy.without_exact(near, exact)


@query(f"WITH {_fuzzy_sql(_BENCH, _DOCS, 20)} SELECT query_id, note_id, round(tf, 12) AS tf, rank FROM exact")
def exact_benchmark(spark, d):
    return _benchmark_signals(spark, d)[2].select("query_id", "note_id", F.round("tf", 12).alias("tf"), "rank")


_LATER_DOCS = "SELECT doc_id AS seg_id, doc_id AS note_id, 'field' AS source, CASE WHEN source = 'src1' THEN text || ' edited anew' ELSE text END AS text FROM documents WHERE coalesce(lang, '') <> 'fr'"


def _later_postings(spark, d):
    """Stored postings after three batches: two thirds of the documents, the others, and a batch that edits some texts and
    removes some documents. Gives the store and the segments that are left."""
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("seg_id"), F.col("doc_id").alias("note_id"), F.lit("field").alias("source"), "text", "lang", F.col("source").alias("origin"))
    held = postings.store(spark, scratch(spark, "postings"), 16)
    first = F.coalesce(F.col("seg_id") % 3 != 0, F.lit(True))
    edited, french = F.col("origin") == "src1", F.col("lang") == "fr"
    after = docs.where(~F.coalesce(french, F.lit(False))).withColumn("text", F.when(edited, F.concat("text", F.lit(" edited anew"))).otherwise(F.col("text")))
    postings.build(held, docs.where(first))
    postings.update(held, docs.limit(0), docs.where(~first))
    postings.update(held, docs.where(edited | french), after.where(edited))
    return held, after


@query(f"SELECT term, count(*) AS df, min(seg_id) AS first_seg, max(seg_id) AS last_seg, sum(seg_id)::BIGINT AS seg_sum FROM (SELECT DISTINCT seg_id, c[i] || c[i + 1] || c[i + 2] AS term FROM (SELECT seg_id, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT seg_id, string_split(lower(text), '') AS c FROM ({_LATER_DOCS})))) GROUP BY term")
def postings_batches(spark, d):
    return _later_postings(spark, d)[0].totals()


@query(f"WITH {_fuzzy_sql(_BENCH, _LATER_DOCS, 20)} SELECT query_id, note_id, overlap, rank FROM fuzzy")
def fuzzy_stored(spark, d):
    held, segments = _later_postings(spark, d)
    bank = t.benchmark_bank(spark, d)
    return fuzzy.fuzzy(bank, segments.select("seg_id", "note_id", "source"), 20, postings=held).select(_FUZZY_COLUMNS)


@query("""SELECT query_id, note_id, rank FROM (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY note_id) AS rank FROM
(SELECT DISTINCT n_nationkey AS query_id, doc_id AS note_id FROM nation JOIN documents ON contains(lower(text), lower(substr(n_name, 1, 2))))) WHERE rank <= 20""")
def exact_fallback_short(spark, d):
    bank = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.substring("n_name", 1, 2).alias("text"))
    return fuzzy.exact_fallback(bank, t.document_segments(spark, d), 20).select("query_id", "note_id", "rank")


_RRF = f"""WITH {_fuzzy_sql(_BENCH, _DOCS, 20)},
fused AS (SELECT query_id, note_id, 1.0::DOUBLE / (60 + rank) AS score, 0 AS tier, 'exact' AS signal, rank AS "at" FROM exact UNION ALL SELECT query_id, note_id, 0.5::DOUBLE / (60 + rank), 1, 'fuzzy', rank FROM rest)
SELECT * FROM (SELECT query_id, note_id, round(score, 12) AS score, tier, signal, "at", row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, note_id) AS rank FROM fused) WHERE rank <= 10"""


@query(_RRF)
def rrf_fused(spark, d):
    bank, segments = t.benchmark_bank(spark, d), t.document_segments(spark, d)
    hits = plans.search(bank, plans.Index(segments), top_k=20, evidence=False).where("rank <= 10")
    signal = F.col("signals")[0]
    return hits.select("query_id", "note_id", F.round("score", 12).alias("score"), F.when(signal["signal"] == "exact", 0).otherwise(1).alias("tier"), signal["signal"].alias("signal"), signal["rank"].alias("at"), "rank")


_ORDER_RANKS = "SELECT c_nationkey AS query_id, lower(substr(o_orderpriority, 3)) AS signal, o_custkey AS note_id, row_number() OVER (PARTITION BY c_nationkey, lower(substr(o_orderpriority, 3)) ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey"
_ORDER_WEIGHTS = {"urgent": 2.0, "high": 1.0, "medium": 0.25, "low": -0.5, "not specified": float("nan")}
_ORDER_RRF = f"""WITH r AS ({_ORDER_RANKS}), b AS (SELECT query_id, signal, note_id, min(rank) AS rank FROM r GROUP BY ALL),
f AS (SELECT query_id, note_id, list_reduce(list_prepend(0.0::DOUBLE, list((CASE signal WHEN 'urgent' THEN 2.0 WHEN 'medium' THEN 0.25 WHEN 'low' THEN -0.5 ELSE 1.0 END)::DOUBLE / (60 + rank)::DOUBLE ORDER BY signal)), lambda s, x: s + x) AS score, min(CASE WHEN signal = 'high' THEN 0 ELSE 1 END) AS tier, string_agg(rank || ':' || signal, ',' ORDER BY rank, signal) AS signals FROM b GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, note_id) AS rank FROM f)"""


def _order_rankings(spark, d):
    orders, customer = t.table(spark, d, "orders"), t.table(spark, d, "customer")
    signal = F.lower(F.expr("substring(o_orderpriority, 3)"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("c_nationkey").alias("query_id"), signal.alias("signal"), F.col("o_custkey").alias("note_id"), "o_totalprice", "o_orderkey")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "signal").orderBy(F.desc("o_totalprice"), "o_orderkey"))).select("query_id", "signal", "note_id", "rank")


@query(f"{_ORDER_RRF} SELECT query_id, note_id, round(score, 12) AS score, tier, rank FROM g")
def rrf_weights(spark, d):
    return fuse.rrf(_order_rankings(spark, d), _ORDER_WEIGHTS, priority=("high",)).select("query_id", "note_id", F.round("score", 12).alias("score"), "tier", "rank")


@query(f"{_ORDER_RRF} SELECT query_id, note_id, signals FROM g WHERE rank <= 10")
def rrf_provenance(spark, d):
    hits = fuse.rrf(_order_rankings(spark, d), _ORDER_WEIGHTS, priority=("high",), top_k=10)
    told = F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["rank"].cast("string"), s["signal"])), ",")
    return hits.select("query_id", "note_id", told.alias("signals"))


@query(f"""WITH {_fuzzy_sql(_BENCH, _DOCS, 20)} SELECT e.query_id, e.note_id, octet_length(encode(substr(s.text, 1, position(lower(trim(b.text)) IN lower(s.text)) - 1))) AS start, octet_length(encode(substr(s.text, 1, position(lower(trim(b.text)) IN lower(s.text)) - 1 + length(trim(b.text))))) AS "end"
FROM exact e JOIN seg s ON e.seg_id = s.seg_id JOIN bank b ON e.query_id = b.query_id""")
def evidence_spans(spark, d):
    bank, segments, exact, _ = _benchmark_signals(spark, d)
    return fuzzy.evidence(exact, bank, segments).select("query_id", "note_id", F.col("span.start").cast("long").alias("start"), F.col("span.end").cast("long").alias("end"))


# ---------------------------------------------------------------- vectors

_SIM = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_R3 = "round_even(sim * 1000, 0)::DOUBLE / 1000"


def _bank(spark, d):
    """Queries: every vector whose id is divisible by 50."""
    return t.embedding_vectors(spark, d).where("note_id % 50 = 0").select(F.col("note_id").alias("query_id"), "vec")


_NEAR = f"SELECT q.vec_id AS query_id, v.vec_id AS note_id, {_SIM} AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"


@query(f"SELECT query_id, note_id, {_R3} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id) AS rank FROM ({_NEAR})) WHERE rank <= 10")
def knn_text(spark, d):
    return knn.semantic(_bank(spark, d), t.embedding_vectors(spark, d), 10, threshold=None)


@query(f"SELECT query_id, note_id, {_R3} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id) AS rank FROM ({_NEAR} AND q.vec_id <> v.vec_id)) WHERE rank <= 10")
def knn_dealt(spark, d):
    """The way that banks of any size take: queries and vectors meet cell by cell."""
    bank = _bank(spark, d)
    found = vector_join.nearest_dealt(bank, t.embedding_vectors(spark, d), 10, exclude=bank.select("query_id", F.col("query_id").alias("note_id")))
    best = found.groupBy("query_id", "note_id").agg(F.max("sim").alias("sim"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "note_id")))
    return ranked.where("rank <= 10").select("query_id", "note_id", vectors.round3("sim").alias("score"), "rank")


@query(f"SELECT query_id, note_id, {_R3} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id) AS rank FROM ({_NEAR})) WHERE rank <= 50 AND {_R3} >= 0.3")
def knn_threshold(spark, d):
    return knn.semantic(_bank(spark, d), t.embedding_vectors(spark, d), 50, threshold=0.3)


@query(f"SELECT query_id, note_id, {_R3} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id) AS rank FROM ({_NEAR} AND q.vec_id <> v.vec_id)) WHERE rank <= 10 AND {_R3} >= 0.2")
def knn_anchor(spark, d):
    return knn.anchors(_bank(spark, d).select(F.col("query_id").alias("note_id")), t.embedding_vectors(spark, d), 10, threshold=0.2)


@query(f"SELECT query_id, note_id, {_R3} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id) AS rank FROM (SELECT query_id, note_id // 5 AS note_id, max(sim) AS sim FROM ({_NEAR}) GROUP BY ALL)) WHERE rank <= 10")
def knn_multivector_maxsim(spark, d):
    many = t.embedding_vectors(spark, d).withColumns({"note_id": F.expr("note_id div 5"), "item": F.expr("cast(note_id % 5 as int)")})
    return knn.semantic(_bank(spark, d), many, 10, threshold=None)


@query("SELECT vec_id AS note_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS length, list_inner_product(embedding::DOUBLE[], list_transform(embedding, lambda x: 1::DOUBLE)) > 0 AS positive FROM embeddings")
def vector_lengths(spark, d):
    unit = t.embedding_vectors(spark, d)
    ones = F.transform("vec", lambda x: F.lit(1.0))
    return unit.select("note_id", F.round(F.sqrt(vectors.inner_product("vec", "vec")), 9).alias("length"), (vectors.inner_product("vec", ones) > 0).alias("positive"))


# ---------------------------------------------------------------- tags, calibration, spaces

_DOC_TAGS = "SELECT doc_id AS note_id, unnest(list_filter(['lang::' || lang, 'src::' || source, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'flag::toxic' END], lambda x: x IS NOT NULL)) AS leaf FROM documents LEFT JOIN labels USING (doc_id)"
_PREFIX = "SELECT DISTINCT note_id, array_to_string(string_split(leaf, '::')[1:i], '::') AS tag FROM (SELECT note_id, leaf, unnest(range(1, len(string_split(leaf, '::')) + 1)) AS i FROM ({}))"


@query(f"SELECT tag, count(*) AS members, min(note_id) AS first_note, max(note_id) AS last_note FROM ({_PREFIX.format(_DOC_TAGS)}) GROUP BY tag")
def tag_membership(spark, d):
    return tags.membership(t.document_notes(spark, d)).groupBy("tag").agg(F.count("*").alias("members"), F.min("note_id").alias("first_note"), F.max("note_id").alias("last_note"))


def _topic_tags(spark, d):
    return tags.membership(t.embedding_vectors(spark, d).select("note_id", F.array(F.concat(F.lit("topic::"), "label")).alias("tags")))


_CENTROIDS = """sums AS (SELECT label, i, sum(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(x * x)) AS n FROM sums GROUP BY label), cent AS (SELECT 'topic::' || s.label AS tag, i, x / n AS x FROM sums s JOIN norms ON s.label = norms.label)"""


def _topic_centroids(spark, d):
    own = t.embedding_vectors(spark, d)
    return tags.centroids(_topic_tags(spark, d), own, own.select("note_id").distinct().count())


@query(f'WITH {_CENTROIDS} SELECT tag, i - 1 AS "at", round(x, 9) AS x FROM cent')
def tag_centroids(spark, d):
    return _topic_centroids(spark, d).select("tag", F.posexplode("vec").alias("at", "x")).select("tag", "at", F.round("x", 9).alias("x"))


@query(f"""WITH {_CENTROIDS}, cv AS (SELECT tag, list(x ORDER BY i) AS vec FROM cent GROUP BY tag),
act AS (SELECT * FROM (SELECT q.vec_id AS query_id, tag, list_inner_product(q.embedding::DOUBLE[], vec) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], vec) DESC, tag) AS tr FROM embeddings q, cv WHERE q.vec_id % 50 = 0) WHERE tr <= 3 AND sim >= 0.05),
m AS (SELECT query_id, tr AS tag_rank, v.vec_id AS note_id, {_SIM} AS sim FROM act JOIN embeddings v ON 'topic::' || v.label = act.tag JOIN embeddings q ON q.vec_id = act.query_id)
SELECT query_id, note_id, tag_rank, {_R3} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tag_rank, sim DESC, note_id) AS rank FROM m) WHERE rank <= 50""")
def tag_signal(spark, d):
    return tags.tag_signal(_bank(spark, d), _topic_centroids(spark, d), _topic_tags(spark, d), t.embedding_vectors(spark, d), activation=0.05)


_SAMPLED = "SELECT q.vec_id, max(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS sim FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 256) q JOIN embeddings v ON q.vec_id <> v.vec_id GROUP BY q.vec_id"


@query(f"SELECT count(*) AS n, round(avg(sim), 9) AS mean, round(stddev_pop(sim), 9) AS std, round(avg(sim) + stddev_pop(sim), 9) AS floor FROM ({_SAMPLED})")
def calibration_stats(spark, d):
    own = t.embedding_vectors(spark, d)
    told = calibrate.activation_stats(own, calibrate.sample_keys(own, lowest=True))
    return told.join(calibrate.floor_of(told)).select("n", *(F.round(c, 9).alias(c) for c in ("mean", "std", "floor")))


#: Ids by position, then 256 steps of the generator, each swapping the next place with a later one.
_DRAWN = """keys AS (SELECT list(k ORDER BY k) AS k, count(*) AS n FROM (SELECT DISTINCT vec_id // 2 AS k FROM embeddings)),
steps AS (SELECT 0 AS i, 11400714819323198485::HUGEINT AS s, k, n FROM keys
UNION ALL SELECT i + 1, x, list_concat(k[1:i], [k[j + 1]], k[i + 2:j], CASE WHEN j > i THEN [k[i + 1]] ELSE [] END, k[j + 2:]), n
  FROM (SELECT *, (i + (x // 8589934592) % (n - i))::BIGINT AS j FROM (SELECT *, (s * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT AS x FROM steps WHERE i < least(256, n)))),
drawn AS (SELECT unnest(k[1:i]) AS note_id FROM (SELECT i, k FROM steps ORDER BY i DESC LIMIT 1))"""


@query(f"""WITH RECURSIVE {_DRAWN}, best AS (SELECT 'clip' || (q.vec_id // 2) % 2 AS space, q.vec_id // 2 AS note_id, max({_SIM}) AS sim FROM embeddings q JOIN embeddings v ON v.vec_id % 2 = 1 AND v.vec_id // 2 <> q.vec_id // 2 AND (v.vec_id // 2) % 2 = (q.vec_id // 2) % 2
WHERE q.vec_id % 2 = 0 AND q.vec_id // 2 IN (SELECT note_id FROM drawn WHERE note_id IN (SELECT vec_id // 2 FROM embeddings WHERE vec_id % 2 = 0)) GROUP BY ALL)
SELECT space, count(*) AS n, round(avg(sim) + stddev_pop(sim), 9) AS floor FROM best GROUP BY space""")
def secondary_floors(spark, d):
    """Even vectors as texts and odd ones as images of the same note, in two spaces."""
    own = t.embedding_vectors(spark, d).select(F.expr("note_id div 2").alias("at"), (F.col("note_id") % 2).alias("odd"), "vec")
    sides = own.select(F.concat(F.lit("clip"), F.col("at") % 2).alias("space"), F.col("at").alias("note_id"), "odd", "vec")
    images, texts = sides.where("odd = 1").drop("odd"), sides.where("odd = 0").drop("odd")
    return calibrate.secondary_floors(images, texts).select("space", "n", F.round("floor", 9).alias("floor"))


@query(f"WITH m AS (SELECT tag, note_id, row_number() OVER (PARTITION BY tag ORDER BY note_id) - 1 AS i, count(*) OVER (PARTITION BY tag) AS n FROM ({_PREFIX.format(_DOC_TAGS)})) SELECT tag, note_id FROM m WHERE i % ((n + 99) // 100) = 0")
def tag_sample(spark, d):
    """Every tag's members thinned by position to at most a hundred, spread over all of them."""
    return positions.strided(tags.membership(t.document_notes(spark, d)), "tag", "note_id", 100)


@query(f"SELECT query_id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, note_id, {_R3} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id) AS rank FROM ({_NEAR})) WHERE rank <= 20) WHERE score > 0.31")
def floor_admit(spark, d):
    return knn.semantic(_bank(spark, d), t.embedding_vectors(spark, d), 20, threshold=None, floor=0.31)


_SPACES = f"""near AS (SELECT query_id, note_id, space, score, rank, max(score) OVER (PARTITION BY query_id, space) AS best FROM (SELECT *, {_R3} AS score, row_number() OVER (PARTITION BY query_id, space ORDER BY sim DESC, note_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id AS note_id, 'clip' || v.label % 3 AS space, {_SIM} AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= 10),
floors AS (SELECT * FROM (VALUES ('clip0', 0.3::DOUBLE), ('clip1', 0.33::DOUBLE), ('clip2', NULL)) f(space, floor)), prim AS (SELECT DISTINCT vec_id AS query_id, 0.34::DOUBLE AS p FROM embeddings WHERE vec_id % 50 = 0),
joined AS (SELECT near.*, floor, p FROM near JOIN floors ON near.space = floors.space JOIN prim ON near.query_id = prim.query_id)"""


_MODES = ("relative", "relative_floor", "soft_relative", "soft_calibrated", "floor_admit", "floor_admit_budget", "soft_floor_admit", "soft_floor_admit_budget")


def _mode_sql(mode: str) -> str:
    keep = ["true"]
    if mode in ("relative", "relative_floor", "soft_relative", "soft_calibrated"):
        keep.append("best >= p")
    if mode.startswith("floor_admit"):
        keep.append("(floor IS NULL OR score > floor)")
    if mode == "relative_floor":
        keep.append("(floor IS NULL OR best > floor)")
    weight = "1.0::DOUBLE"
    if mode == "soft_relative":
        weight = "1 / (1 + exp(-((best - p) / 0.05)))"
    elif mode in ("soft_calibrated", "soft_floor_admit", "soft_floor_admit_budget"):
        weight = "coalesce(1 / (1 + exp(-((best - floor) / 0.05))), 1.0)"
    rows = f"SELECT query_id, space, note_id, {weight} AS w, row_number() OVER (PARTITION BY query_id, space ORDER BY score DESC, note_id) AS rank FROM joined WHERE {' AND '.join(keep)}"
    scale = "w"
    total = f"SELECT *, sum(CASE WHEN rank = 1 THEN w END) OVER (PARTITION BY query_id) AS total, count(CASE WHEN rank = 1 THEN 1 END) OVER (PARTITION BY query_id) AS n FROM ({rows})"
    if mode.endswith("_budget"):
        scale = "CASE WHEN n >= 2 AND total > 1.0 THEN w * (1.0 / total) ELSE w END"
    return f"SELECT '{mode}' AS mode, query_id, 'image#' || space AS signal, note_id, rank, round({scale}, 9) AS weight FROM ({total})"


@query(f"WITH {_SPACES} " + " UNION ALL ".join(map(_mode_sql, _MODES)))
def cross_space_modes(spark, d):
    own, bank = t.embedding_vectors(spark, d), _bank(spark, d)
    itself = bank.select("query_id", F.col("query_id").alias("note_id"))
    parts = []
    for i in range(3):
        hits = knn.semantic(bank, own.where(f"label % 3 = {i}"), 10, threshold=None, exclude=itself)
        parts.append(hits.withColumn("space", F.lit(f"clip{i}")))
    hits = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("rank")
    hits = hits.withColumn("best", F.max("score").over(Window.partitionBy("query_id", "space")))
    floors = spark.createDataFrame([("clip0", 0.3), ("clip1", 0.33), ("clip2", None)], "space string, floor double")
    primary = bank.select("query_id", F.lit(0.34).alias("best"))
    out = None
    for mode in fuse.MODES:
        rankings, weights = fuse.cross_space(hits, floors, primary, mode)
        one = rankings.join(weights, ["query_id", "signal"]).select(F.lit(mode).alias("mode"), "query_id", "signal", "note_id", "rank", F.round("weight", 9).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT b AS bucket, count(sim) AS n FROM range(20) r(b) LEFT JOIN (SELECT greatest(least(floor(sim * 20)::INT, 19), 0) AS k, sim FROM (SELECT v.vec_id, max(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY v.vec_id)) ON b = k GROUP BY b")
def dedup_histogram(spark, d):
    own, bank = t.embedding_vectors(spark, d), _bank(spark, d)
    best = knn.best_in_bank(own, bank)
    return calibrate.duplicate_histogram(best)


@query("SELECT 'text' AS modality, count(*) AS vectors, count(DISTINCT vec_id) AS notes, max(len(embedding)) AS ndim FROM embeddings")
def index_status(spark, d):
    return stats.index_status(t.embedding_vectors(spark, d))


@query("""WITH s AS (SELECT DISTINCT 'clip' || label % 2 AS space, CASE WHEN label % 4 = 1 THEN 'image' ELSE 'text' END AS modality FROM embeddings), m AS (SELECT DISTINCT 'audio' AS modality FROM conversations WHERE role = 'assistant')
SELECT query, target, CASE WHEN EXISTS (SELECT 1 FROM s a JOIN s b ON a.space = b.space WHERE a.modality = query AND b.modality = target) THEN 'native'
WHEN query IN (SELECT modality FROM s) AND 'text' IN (SELECT modality FROM s) AND target IN (SELECT modality FROM m) THEN 'via_derived_text' ELSE 'unavailable' END AS status
FROM (VALUES ('text'), ('image'), ('audio')) a(query), (VALUES ('text'), ('image'), ('audio')) b(target)""")
def coverage_matrix(spark, d):
    """Spaces and modalities as the stored vectors have them; turns of assistants stand for recognised speech."""
    modality = F.when(F.col("label") % 4 == 1, "image").otherwise("text")
    spaces = t.table(spark, d, "embeddings").select(F.concat(F.lit("clip"), F.col("label") % 2).alias("space"), modality.alias("modality")).distinct()
    made = t.table(spark, d, "conversations").where("role = 'assistant'").select(F.lit("audio").alias("modality")).distinct()
    return stats.coverage_matrix(spaces, made)


# ---------------------------------------------------------------- structured reads

_CUSTOMERS = "SELECT c_custkey AS note_id, CASE WHEN c_acctbal < 0 THEN 'Cloze' ELSE 'Basic' END AS note_type, r_name || '::' || n_name AS deck, 'segment::' || lower(c_mktsegment) AS tag, c_name, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS modified FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_ASIA = "(lower(deck) = 'asia' OR starts_with(lower(deck), 'asia::'))"


@query(f"SELECT note_id, note_type, deck FROM ({_CUSTOMERS}) WHERE {_ASIA} AND note_type = 'Basic'")
def list_notes_deck(spark, d):
    return filters.list_notes(t.customer_notes(spark, d), deck="ASIA", note_type="Basic")[0].select("note_id", "note_type", "deck")


@query(f"SELECT note_id, tag FROM ({_CUSTOMERS}) WHERE tag <> 'segment::building'")
def list_notes_tags(spark, d):
    found = filters.list_notes(t.customer_notes(spark, d), tags=["segment", "-segment::building"])[0]
    return found.select("note_id", F.col("tags")[0].alias("tag"))


@query(f"SELECT note_id, epoch_us(modified) // 1000000 AS seconds FROM ({_CUSTOMERS}) WHERE modified >= TIMESTAMP '1998-06-01 00:00:00'")
def list_notes_since(spark, d):
    return filters.list_notes(t.customer_notes(spark, d), modified_since="1998-06-01")[0].select("note_id", F.unix_timestamp("modified").alias("seconds"))


@query(f"SELECT note_id, deck FROM ({_CUSTOMERS}) WHERE ({_ASIA} OR starts_with(lower(deck), 'europe::')) AND NOT tag = 'segment::machinery' AND note_type = 'Basic'")
def query_lang_boolean(spark, d):
    return filters.collection_query(t.customer_notes(spark, d), "(deck:ASIA OR deck:europe) -tag:segment::machinery note:Basic")[0].select("note_id", "deck")


@query(f"SELECT note_id FROM ({_CUSTOMERS}) WHERE contains(lower(c_name), '0001') AND note_id IN (1, 11, 12, 13, 100, 1001, 1002) OR tag = 'segment::furniture' AND {_ASIA}")
def query_lang_text(spark, d):
    return filters.collection_query(t.customer_notes(spark, d), '"0001" nid:1,11,12,13,100,1001,1002 OR tag:segment::furn* deck:asia')[0].select("note_id")


_DECKS = "SELECT n_nationkey::BIGINT AS deck_id, r_name || '::' || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -r_regionkey - 1, r_name FROM region"
_CARDS = "SELECT o_orderkey AS card_id, o_custkey AS note_id, c_nationkey::BIGINT AS deck_id, substr(o_orderpriority, 1, 1)::BIGINT AS original_deck_id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'learn' ELSE 'review' END AS queue FROM orders JOIN customer ON o_custkey = c_custkey"
_ROLLUP = f"""decks AS ({_DECKS}), cards AS ({_CARDS}), up AS (SELECT a.deck_id, b.name FROM decks a JOIN decks b ON a.name = b.name OR starts_with(a.name, b.name || '::')),
pairs AS (SELECT DISTINCT name, note_id FROM (SELECT note_id, deck_id FROM cards UNION SELECT note_id, original_deck_id FROM cards WHERE original_deck_id <> 0) c JOIN up ON c.deck_id = up.deck_id),
counts AS (SELECT name, count(*) AS notes FROM pairs GROUP BY name), due AS (SELECT name, count(*) FILTER (queue IN ('learn', 'review')) AS due, count(*) FILTER (queue = 'new') AS new FROM cards c JOIN up ON c.deck_id = up.deck_id GROUP BY name)"""


@query(f"WITH {_ROLLUP} SELECT d.name, coalesce(notes, 0) AS notes FROM decks d LEFT JOIN counts c ON d.name = c.name")
def deck_rollup(spark, d):
    return stats.deck_note_counts(t.order_cards(spark, d), t.nation_decks(spark, d))


@query(f"WITH {_ROLLUP} SELECT d.name, coalesce(notes, 0) AS notes, coalesce(due, 0) AS due, coalesce(new, 0) AS new FROM decks d LEFT JOIN counts c ON d.name = c.name LEFT JOIN due ON d.name = due.name")
def collection_stats(spark, d):
    return stats.deck_stats(t.customer_notes(spark, d), t.order_cards(spark, d), t.nation_decks(spark, d))


@query(f"""WITH {_ROLLUP} SELECT (SELECT count(*) FROM customer) AS notes, (SELECT count(*) FROM orders) AS cards, (SELECT count(*) FROM decks) AS decks, 2::BIGINT AS note_types, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS tags,
(SELECT sum(due) FROM due WHERE NOT contains(name, '::'))::BIGINT AS due, (SELECT sum(new) FROM due WHERE NOT contains(name, '::'))::BIGINT AS new""")
def collection_summary(spark, d):
    types = spark.createDataFrame([("Basic",), ("Cloze",)], "name string")
    registry = t.table(spark, d, "customer").select("c_mktsegment")
    return stats.summary(t.customer_notes(spark, d), t.order_cards(spark, d), t.nation_decks(spark, d), types, registry).drop("modified")


@query(f"WITH n AS ({_CUSTOMERS}) SELECT name, coalesce(notes, 0) AS notes FROM (VALUES ('Basic'), ('Cloze'), ('Unused')) v(name) LEFT JOIN (SELECT note_type, count(*) AS notes FROM n GROUP BY note_type) c ON c.note_type = v.name")
def note_type_use(spark, d):
    types = spark.createDataFrame([("Basic",), ("Cloze",), ("Unused",)], "name string")
    return stats.use_counts(t.customer_notes(spark, d), t.order_cards(spark, d), t.nation_decks(spark, d), types)[0]


@query("SELECT l_orderkey AS note_id, coalesce(s_name, 'Default') AS deck FROM (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS deck_id FROM lineitem GROUP BY l_orderkey) LEFT JOIN supplier ON deck_id = s_suppkey")
def first_card_deck(spark, d):
    lines = t.table(spark, d, "lineitem")
    raw = lines.select(F.col("l_orderkey").alias("note_id")).distinct().select("note_id", F.lit(1).alias("type_id"), F.lit("").alias("flds"), F.lit("").alias("tags"), F.lit(None).cast("timestamp").alias("modified"))
    types = spark.createDataFrame([], "type_id int, name string, fields array<struct<ord:int,name:string>>")
    cards = lines.select(F.col("l_orderkey").alias("note_id"), F.col("l_suppkey").alias("deck_id"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("card_id"))
    decks = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("deck_id"), F.col("s_name").alias("name"))
    return sources.typed_notes(raw, types, cards, decks, with_fields=False).select("note_id", "deck")


# ---------------------------------------------------------------- text functions

#: The SQL's own values: it checks those of the functions.
_HTML = "html"
_LINE_TAG = r"(?i)<\s*(?:/\s*)?(?:h[1-6]|p|br|div|ul|ol|li|tr|td|blockquote)\b[^>]*>"
for _p, _r in ((r"(?i)\[/?latex\]|\[/?\$\$?\]|\\[()]|\\[\[\]]|\$\$", " "), (r"(?i)\[sound:[^\]]*\]", " "), (_LINE_TAG, " "), (r"(?s)<!--.*?-->", ""), (r"(?is)<style\b.*?</style\s*>", ""), (r"(?is)<script\b.*?</script\s*>", ""), (r"(?s)<[^>]*>", "")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_r}', 'g')"
for _name, _char in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)")):
    _HTML = f"replace({_HTML}, '{_name}', {_char})"
_HTML = f"trim(regexp_replace(replace(regexp_replace({_HTML}, '&amp;?', '&', 'g'), chr(160), ' '), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_HTML}) AS n_chars, sha256({_HTML}) AS text_sha256 FROM pages")
def embed_text_pages(spark, d):
    plain = text.normalize_for_embedding("html")
    return t.table(spark, d, "pages").select("page_id", F.length(plain).cast("long").alias("n_chars"), F.sha2(plain, 256).alias("text_sha256"))


_FOLDED = "SELECT doc_id, 'İ' || substr(text, 1, length(text) // 2) || '😀İẞ' || text AS v, substr(text, length(text) // 3 + 1, 12) AS n FROM documents WHERE length(text) >= 40"


@query(rf"""WITH v AS (SELECT doc_id, v, lower(trim(n)) AS needle, string_split(v, '') AS c FROM ({_FOLDED}) WHERE trim(n) <> ''),
f AS (SELECT doc_id, needle, c, list_transform(c, lambda x: lower(x)) AS l, position(needle IN lower(v)) AS place FROM v),
p AS (SELECT doc_id, needle, place, unnest(c) AS ch, unnest(l) AS low, unnest(range(len(c))) AS i FROM f WHERE place > 0),
q AS (SELECT *, sum(length(low)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(octet_length(encode(ch))) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM p)
SELECT doc_id, coalesce(max(bytes) FILTER (upto < place), 0)::BIGINT AS start, max(bytes) FILTER (upto - length(low) < place - 1 + length(needle))::BIGINT AS "end" FROM q GROUP BY doc_id""")
def folded_spans(spark, d):
    """Spans in texts whose lower case is longer than they are."""
    docs = t.table(spark, d, "documents").where("length(text) >= 40")
    half = F.expr("concat('İ', substr(text, 1, cast(length(text) div 2 as int)), '😀İẞ', text)")
    told = docs.select("doc_id", half.alias("v"), F.expr("substr(text, cast(length(text) div 3 as int) + 1, 12)").alias("n")).where("trim(n) <> ''")
    spans = told.select("doc_id", F.explode(F.array_compact(F.array(text.byte_span("v", "n")))).alias("span"))
    return spans.select("doc_id", F.col("span.start").cast("long").alias("start"), F.col("span.end").cast("long").alias("end"))


_CLOZED = "SELECT doc_id, '{{c1::' || replace(replace(replace(text, ':', ''), '{', ''), '}', '') || '::hint}} and {{c2::' || lang || '}}' AS v FROM documents"


@query(rf"SELECT doc_id, regexp_replace(v, '\{{\{{c\d+::([^{{}}:]*)(?:::[^{{}}]*)?\}}\}}', '\1', 'g') AS filled FROM ({_CLOZED})")
def cloze_fill(spark, d):
    part = F.regexp_replace("text", "[:{}]", "")
    value = F.concat(F.lit("{{c1::"), part, F.lit("::hint}} and {{c2::"), "lang", F.lit("}}"))
    return t.table(spark, d, "documents").select("doc_id", text.fill_clozes(value).alias("filled"))


@query("SELECT doc_id, source || '.mp3,' || lang || '.ogg' AS names FROM documents")
def sound_refs(spark, d):
    value = F.concat(F.lit("a [sound:x/"), "source", F.lit(".mp3] b [SOUND:"), "lang", F.lit(".ogg][sound:http://h/y.mp3] [sound:"), "source", F.lit(".mp3]"))
    return t.table(spark, d, "documents").select("doc_id", F.array_join(text.sound_refs(value), ",").alias("names"))


@query("SELECT count(*) AS n, count(*) FILTER (trim(regexp_replace(text, '\\s+', ' ', 'g')) = '') AS blank FROM documents")
def blank_fields(spark, d):
    return t.table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(text.is_blank("text")).alias("blank"))


@query("SELECT doc_id, sha256(replace(text, 'the', 'THE')) AS after FROM documents WHERE contains(text, 'the')")
def find_replace_literal(spark, d):
    changed = mutate.find_replace(t.document_notes(spark, d), "the", "THE")[1]
    return changed.select(F.col("note_id").alias("doc_id"), F.sha2(F.col("after")[0]["value"], 256).alias("after"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '([a-z]+)ing', '<\1>', 'g')) AS after FROM documents WHERE regexp_matches(text, '[a-z]+ing')")
def find_replace_regex(spark, d):
    changed = mutate.find_replace(t.document_notes(spark, d), "([a-z]+)ing", r"<\1>", regex=True)[1]
    return changed.select(F.col("note_id").alias("doc_id"), F.sha2(F.col("after")[0]["value"], 256).alias("after"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def note_hashes(spark, d):
    payload = hashing.note_payload("text")
    return incremental.fingerprints(t.table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), payload.alias("payload")), "sha256").withColumnRenamed("note_id", "doc_id")


# ---------------------------------------------------------------- changes

@query("SELECT doc_id AS note_id, CASE WHEN lang = 'en' THEN 'language::english' ELSE 'lang::' || lang END AS tag FROM documents")
def rename_tag(spark, d):
    after, _ = mutate.rename_tag(t.document_notes(spark, d), "lang::en", "language::english")
    return after.select("note_id", F.col("tags")[0].alias("tag"))


@query("SELECT doc_id AS note_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS reviewed, (CASE WHEN quality IS NULL THEN 2 ELSE 3 END) + (CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS n_tags FROM documents LEFT JOIN labels USING (doc_id)")
def tag_update(spark, d):
    own = t.document_notes(spark, d)
    after = mutate.update_tags(own, own.where(filters.has_tag("flag")), add=["reviewed"], remove=["flag::toxic"])
    return after.select("note_id", F.when(F.array_contains("tags", "reviewed"), 1).otherwise(0).alias("reviewed"), F.size("tags").alias("n_tags"))


_UPSERTED = """WITH items AS (SELECT doc_id AS index, CASE WHEN n_chars % 7 = 0 THEN doc_id END AS id, CASE WHEN n_chars % 5 = 0 THEN 'Nope' ELSE 'Basic' END AS note_type, trim(text) AS front FROM documents),
judged AS (SELECT *, CASE WHEN id IS NULL AND note_type = 'Nope' THEN 'unknown_note_type' WHEN id IS NULL AND front = '' THEN 'empty' WHEN id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = id AND o.lang = 'en') THEN 'gone' WHEN id IS NOT NULL AND note_type <> 'Basic' THEN 'changed' END AS why FROM items),
keyed AS (SELECT *, id IS NULL AND why IS NULL AND (EXISTS (SELECT 1 FROM documents o WHERE o.lang = 'en' AND trim(o.text) = front) OR row_number() OVER (PARTITION BY id IS NULL AND why IS NULL, front ORDER BY index) > 1) AS twin FROM judged)"""


def _upsert_parts(spark, d):
    docs = t.table(spark, d, "documents")
    front = F.trim("text")
    items = docs.select(F.col("doc_id").alias("index"), F.when(F.col("n_chars") % 7 == 0, F.col("doc_id")).alias("id"), F.when(F.col("n_chars") % 5 == 0, "Nope").otherwise("Basic").alias("note_type"), F.lit("Deck").alias("deck"), F.create_map(F.lit("Front"), front).alias("fields"), F.array(F.lit("t")).alias("tags"))
    notes = docs.where("lang = 'en'").select(F.col("doc_id").alias("note_id"), F.lit("g").alias("guid"), F.lit("Basic").alias("note_type"), F.lit("Deck").alias("deck"), F.array(F.lit("t")).alias("tags"), F.lit(None).cast("timestamp").alias("modified"), F.array(F.struct(F.lit(0).alias("ord"), F.lit("Front").alias("name"), front.alias("value"))).alias("fields"))
    types = spark.createDataFrame([("Basic", "standard", [(0, "Front"), (1, "Back")])], "name string, kind string, fields array<struct<ord:int,name:string>>")
    return items, notes, types, spark.createDataFrame([(1, "Deck")], "deck_id long, name string")


@query(f"{_UPSERTED} SELECT index, CASE WHEN why IS NOT NULL OR twin THEN 'error' WHEN id IS NULL THEN 'created' ELSE 'updated' END AS status, CASE WHEN why IN ('unknown_note_type', 'empty') THEN why WHEN twin THEN 'duplicate' END AS reason FROM keyed")
def upsert_classify(spark, d):
    return mutate.upsert_classify(*_upsert_parts(spark, d)).select("index", "status", "reason")


@query(f"{_UPSERTED}, p AS (SELECT status, count(*) AS n, policy FROM (SELECT 'skip' AS policy, CASE WHEN why IS NOT NULL THEN 'error' WHEN twin THEN 'skipped' WHEN id IS NULL THEN 'created' ELSE 'updated' END AS status FROM keyed UNION ALL SELECT 'allow', CASE WHEN why IS NOT NULL THEN 'error' WHEN id IS NULL THEN 'created' ELSE 'updated' END FROM keyed) GROUP BY ALL) SELECT policy, status, n FROM p")
def duplicate_policy(spark, d):
    parts = _upsert_parts(spark, d)
    out = [mutate.upsert_classify(*parts, duplicates=p).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(p).alias("policy"), "status", "n") for p in ("skip", "allow")]
    return out[0].unionByName(out[1])


@query("SELECT c_custkey AS note_id, CASE WHEN c_acctbal < 0 THEN 'Basic' ELSE 'Basic' END AS note_type, CASE WHEN c_acctbal < 0 THEN 'Front' ELSE 'Name' END AS first_name, c_name AS first_value FROM customer")
def migrate_fields(spark, d):
    own = t.customer_notes(spark, d)
    types = spark.createDataFrame([("Cloze", [(0, "Name"), (1, "Balance")]), ("Basic", [(0, "Front"), (1, "Back"), (2, "Extra")])], "name string, fields array<struct<ord:int,name:string>>")
    after, _ = mutate.migrate_note_type(own, own.where("note_type = 'Cloze'").select("note_id"), types, "Basic", {"Name": "Front", "Balance": "Extra"})
    return after.select("note_id", "note_type", F.col("fields")[0]["name"].alias("first_name"), F.col("fields")[0]["value"].alias("first_value"))


@query("""WITH n AS (SELECT c_custkey, c_acctbal < 0 AS cloze, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END AS note, CASE WHEN c_custkey % 4 = 0 THEN ' <br>&nbsp;' ELSE c_name END AS hint FROM customer)
SELECT o_orderkey AS card_id, CASE WHEN cloze THEN NOT (o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND c_custkey % 2 = 0)
WHEN o_orderkey % 3 = 0 THEN note = '' OR starts_with(hint, ' <') WHEN o_orderkey % 3 = 1 THEN note <> '' AND starts_with(hint, ' <') ELSE true END AS empty FROM orders JOIN n ON o_custkey = c_custkey""")
def empty_cards(spark, d):
    """Orders as cards of customers; templates with sections, filters, clozes, and one without any field."""
    customer, orders = t.table(spark, d, "customer"), t.table(spark, d, "orders")
    field = lambda i, name, value: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), value.alias("value"))
    hint = F.when(F.col("c_custkey") % 4 == 0, " <br>&nbsp;").otherwise(F.col("c_name"))
    cloze = F.concat(F.lit("{{c1::one}}"), F.when(F.col("c_custkey") % 2 == 0, " {{c2::two}}").otherwise(""))
    fields = F.array(field(0, "Note", F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))), field(1, "Hint", hint), field(2, "Text", cloze))
    own = customer.select(F.col("c_custkey").alias("note_id"), F.when(F.col("c_acctbal") < 0, "Gaps").otherwise("Plain").alias("note_type"), fields.alias("fields"))
    fronts = ["{{#Note}}<b>{{hint:Hint}}</b>{{/Note}}", "{{Hint}} {{^Note}}or {{Text}}{{/Note}}", "nothing of the note"]
    types = spark.createDataFrame([("Plain", "standard", [(i, f) for i, f in enumerate(fronts)]), ("Gaps", "cloze", [(0, "{{cloze:Text}}")])], "name string, kind string, templates array<struct<ord:int,front:string>>")
    made = orders.select(F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("note_id"), (F.col("o_orderkey") % 3).cast("int").alias("ord"))
    return cards.empty_cards(made, own, types).select("card_id", "empty")


@query("SELECT tag FROM (SELECT p_type AS tag FROM part UNION SELECT 'LANG::' || upper(lang) FROM documents UNION SELECT 'lang') WHERE lower(tag) <> 'lang' AND NOT starts_with(lower(tag), 'lang::')")
def prune_unused_tags(spark, d):
    registry = t.table(spark, d, "part").select(F.col("p_type").alias("tag")).union(t.table(spark, d, "documents").select(F.concat(F.lit("LANG::"), F.upper("lang")))).union(spark.createDataFrame([("lang",)], "tag string")).distinct()
    return tags.unused_tags(registry, t.document_notes(spark, d))


@query("SELECT event_id AS note_id, CASE WHEN doc_id IS NULL THEN 'not_found' ELSE 'deleted' END AS status FROM events LEFT JOIN documents ON event_id = doc_id")
def delete_found_notfound(spark, d):
    return mutate.delete_notes(t.document_notes(spark, d), t.table(spark, d, "events").select(F.col("event_id").alias("note_id")))[1]


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN a.c_custkey IS NULL THEN 'new' WHEN a.kind <> b.kind THEN 'conflicting' WHEN b.at > a.at THEN 'updated' ELSE 'duplicate' END AS bucket FROM (SELECT c_custkey, c_acctbal < 0 AS kind, 10 AS at FROM customer WHERE c_nationkey < 15) a RIGHT JOIN (SELECT c_custkey, c_acctbal < 1000 AS kind, c_nationkey AS at FROM customer WHERE c_nationkey > 5) b ON a.c_custkey = b.c_custkey) GROUP BY bucket")
def import_buckets(spark, d):
    customer = t.table(spark, d, "customer")
    at = lambda c: F.timestamp_seconds(c)
    row = lambda kind, when: [F.col("c_custkey").alias("note_id"), F.col("c_name").alias("guid"), F.when(kind, "Cloze").otherwise("Basic").alias("note_type"), when.alias("modified")]
    ours = customer.where("c_nationkey < 15").select(row(F.col("c_acctbal") < 0, at(F.lit(10))))
    theirs = customer.where("c_nationkey > 5").select(row(F.col("c_acctbal") < 1000, at(F.col("c_nationkey"))))
    return sources.import_package(ours, theirs)[1]


# ---------------------------------------------------------------- incremental upkeep

@query("SELECT note_id, CASE WHEN now IS NULL THEN 'remove' ELSE 'embed' END AS action FROM (SELECT coalesce(a.doc_id, b.doc_id) AS note_id, a.h AS was, b.h AS now FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'fr') a FULL JOIN (SELECT doc_id, sha256(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'de') b ON a.doc_id = b.doc_id) WHERE was IS DISTINCT FROM now")
def reconcile_diff(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text", "lang", "source")
    old = incremental.fingerprints(docs.where("lang <> 'fr'").select("note_id", F.col("text").alias("payload")), "sha256")
    new = incremental.fingerprints(docs.where("lang <> 'de'").select("note_id", F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("payload")), "sha256")
    return incremental.reconcile(old, new)


@query("SELECT note_id, CASE WHEN kind = 'Maintain' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = note_id AND c_acctbal >= 0) THEN 'maintain' ELSE 'remove' END AS action FROM (SELECT user_id AS note_id, arg_max(CASE WHEN event_type = 'error' THEN 'Remove' ELSE 'Maintain' END, event_id) AS kind FROM events WHERE event_type <> 'click' GROUP BY user_id)")
def drain_merge(spark, d):
    there = t.table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("note_id"))
    return incremental.drain_merge(t.event_changes(spark, d), there)


@query("""WITH c AS (SELECT user_id, event_id, event_type <> 'error' AS ok, event_type = 'signup' AS clear FROM events), e AS (SELECT *, sum(clear::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM c),
f AS (SELECT *, min(CASE WHEN NOT ok AND NOT clear THEN event_id END) OVER (PARTITION BY user_id, era ORDER BY event_id) AS floor FROM e)
SELECT user_id AS note_id, event_id AS col_mod, max(CASE WHEN clear OR (ok AND (floor IS NULL OR floor > event_id)) THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS watermark, floor FROM f""")
def watermark_floor(spark, d):
    return incremental.watermarks(t.event_changes(spark, d), "note_id", "col_mod")


_BATCHES = 5
_STREAM = f"""WITH e AS (SELECT user_id, event_id, event_type, (event_id - min(event_id) OVER ()) * {_BATCHES} // (max(event_id) OVER () - min(event_id) OVER () + 1) AS batch FROM events),
c AS (SELECT user_id AS note_id, batch, event_id, CASE WHEN event_type = 'error' OR c_custkey IS NULL THEN 'remove' ELSE 'maintain' END AS action FROM e LEFT JOIN customer ON user_id = c_custkey WHERE event_type <> 'click'),
b AS (SELECT note_id, batch, arg_max(action, event_id) AS action FROM c GROUP BY note_id, batch),
last AS (SELECT note_id, arg_max(action, batch) AS action, bool_or(action = 'remove') AS gone FROM b GROUP BY note_id),
marks AS (SELECT max(event_id) FILTER (event_type <> 'error' AND event_id < coalesce((SELECT min(event_id) FROM e WHERE event_type = 'error'), 9223372036854775807)) AS watermark, min(event_id) FILTER (event_type = 'error') AS floor FROM e)
SELECT rows.*, watermark, floor FROM (SELECT c_custkey AS note_id, 'ocr' AS source, c_mktsegment AS text FROM customer LEFT JOIN last ON note_id = c_custkey WHERE NOT coalesce(gone, false)
UNION ALL SELECT note_id, 'field', upper(c_name) FROM last JOIN customer ON note_id = c_custkey WHERE action = 'maintain') rows, marks"""


@query(_STREAM)
def stream_upkeep(spark, d):
    """Events as a stream of five batches of files, over a table that holds recognised rows of all customers."""
    customer, folder = t.table(spark, d, "customer"), scratch(spark, "upkeep")
    table = Buckets(spark, f"{folder}/table", ["note_id"], "note_id long, source string, text string", 16)
    table.write(customer.select(F.col("c_custkey").alias("note_id"), F.lit("ocr").alias("source"), F.col("c_mktsegment").alias("text")))
    changes = t.event_changes(spark, d).select("note_id", "col_mod", "kind", "success")
    low, high = changes.agg(F.min("col_mod"), F.max("col_mod")).first()
    files = 4
    for i in range(_BATCHES if low is not None else 0):
        part = changes.where(F.expr(f"(col_mod - {low}) * {_BATCHES} div {high - low + 1} = {i}"))
        part.repartition(files).write.mode("append").parquet(f"{folder}/changes")
    notes = lambda: customer.select(F.col("c_custkey").alias("note_id"), F.col("c_name").alias("name"))
    derive = lambda rows: rows.select("note_id", F.lit("field").alias("source"), F.upper("name").alias("text"))
    if low is not None:
        maintain.maintain(maintain.read_changes(spark, f"{folder}/changes", files), notes, table, f"{folder}/stream", derive, carry=F.col("source") == "ocr").awaitTermination()
    marks = table.note()
    return table.read().withColumns({x: F.lit(marks.get(x)).cast("long") for x in ("watermark", "floor")})


@query("SELECT conv_id, turn, CASE WHEN (turn % 4) / 4.0 < 0.5 OR length(trim(text)) < 4 THEN 'drop' WHEN length(trim(text)) >= 20 THEN 'lexical_and_vector' ELSE 'lexical' END AS outcome FROM conversations")
def recognition_gate(spark, d):
    rows = t.table(spark, d, "conversations").withColumn("confidence", (F.col("turn") % 4) / 4)
    return rows.select("conv_id", "turn", incremental.judge().alias("outcome"))


@query("SELECT doc_id AS note_id, source AS ref FROM documents WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def pending_media(spark, d):
    refs = t.table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("ref"), "lang")
    gated = refs.join(t.table(spark, d, "labels").select(F.col("doc_id").alias("note_id")), "note_id", "left_semi").select("note_id", "ref")
    return incremental.pending(refs, refs.where("lang = 'en'").select("note_id", "ref"), gated)


# ---------------------------------------------------------------- measures

_GOLD = "SELECT item_id AS query_id, doc_id AS note_id, 2 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query(f"""WITH {_fuzzy_sql(_BENCH, _DOCS, 10)}, gold AS ({_GOLD}), j AS (SELECT f.query_id, f.rank, coalesce(grade, 0) AS grade FROM fuzzy f LEFT JOIN gold g ON f.query_id = g.query_id AND f.note_id = g.note_id),
own AS (SELECT query_id, count(*) AS returned, count(*) FILTER (grade = 2 AND rank <= 1) AS f1, count(*) FILTER (grade = 2 AND rank <= 5) AS f5, count(*) FILTER (grade = 2) AS fk, min(CASE WHEN grade = 2 THEN rank END) AS first, sum(grade / log2(rank + 1)) AS dcg, count(*) FILTER (grade = 0) AS wrong FROM j GROUP BY query_id),
ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN r <= 10 THEN 2 / log2(r + 1) END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY note_id) AS r FROM gold) GROUP BY query_id)
SELECT b.query_id, coalesce(returned, 0) AS returned, coalesce(f1, 0) / relevant AS recall_at_1, coalesce(f5, 0) / relevant AS recall_at_5, coalesce(fk, 0) / relevant AS recall_at_k, CASE WHEN relevant > 0 THEN coalesce(1.0 / first, 0.0)::DOUBLE END AS mrr, round(coalesce(dcg, 0) / idcg, 9) AS ndcg_at_10, fk / least(returned, 10) AS precision_at_k, coalesce(wrong / returned, 0.0)::DOUBLE AS false_positive_rate
FROM bank b LEFT JOIN own ON b.query_id = own.query_id LEFT JOIN ideal ON b.query_id = ideal.query_id""")
def ir_metrics(spark, d):
    bank, segments = t.benchmark_bank(spark, d), t.document_segments(spark, d)
    near = fuzzy.fuzzy(bank, segments, 10)
    gold = fuzzy.containing(bank, segments).select("query_id", "note_id", F.lit(2).alias("grade"))
    told = stats.ir_metrics(near.select("query_id", "note_id", "rank"), gold, bank)
    return told.select("query_id", "returned", "recall_at_1", "recall_at_5", "recall_at_k", "mrr", F.round("ndcg_at_10", 9).alias("ndcg_at_10"), "precision_at_k", "false_positive_rate")


@query("""SELECT event_type, count(*) AS n, round(min(value), 9) AS min, round(max(value), 9) AS max, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.99), 9) AS p99,
round(quantile_cont(value, 0.5) FILTER (i > floor(m / 2)) - quantile_cont(value, 0.5) FILTER (i <= floor(m / 2)), 9) AS drift FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type""")
def latency_distribution(spark, d):
    told = stats.latency_distribution(t.table(spark, d, "events"), "event_type", "value", "event_id")
    return told.select("event_type", "n", *(F.round(c, 9).alias(c) for c in ("min", "max", "p50", "p90", "p99", "drift")))


@query()
def search_notes(spark, d):
    """All signals at once over documents: letters of the bank, synthetic vectors of bank and texts, tags."""
    bank, segments = t.benchmark_bank(spark, d), t.document_segments(spark, d)
    embed = vectors.synthetic_embedder(32)
    own = checkpoint(segments.select("note_id", F.lit("text").alias("modality"), F.lit(0).alias("item"), embed("text").alias("vec")))
    notes = t.document_notes(spark, d)
    members = tags.membership(notes)
    index = plans.Index(segments, own, members, tags.centroids(members, own, notes.count()))
    hits = plans.search(bank, index, 10, bank.select("query_id", embed("text").alias("vec")))
    return hits.select("query_id", "rank", "note_id", "score", "semantic", F.array_join(F.transform("signals", lambda s: s["signal"]), ",").alias("signals"), F.col("substring.span").alias("span"))


@query()
def note_fingerprints(spark, d):
    """BLAKE2b fingerprints of all documents, for which SQL has no function."""
    return incremental.fingerprints(t.table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), hashing.note_payload("text").alias("payload")))


@query()
def image_refs(spark, d):
    """Image names of pages' markup by a tokeniser."""
    return t.table(spark, d, "pages").select("page_id", text.image_refs("html").alias("names"))
