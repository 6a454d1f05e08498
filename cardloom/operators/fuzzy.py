"""Typo-tolerant and literal search for a bank of queries at once.

A query keeps its rarest present trigrams (and all absent ones); segments are ranked by how many of the kept ones they hold.
All queries are answered by one plan. Without stored postings texts are read twice: a task counts the bank's terms, and once
the kept ones are known each segment says which of those it holds. Segments then meet the queries in blocks (``overlap``), so
no row is made per query and segment; texts are joined to the survivors alone. A bank whose distinct terms can be carried is
pruned where its texts are read, by the terms' counts; no row is made per query and term.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.text import byte_span, coded, nfc, occurrences, packed_trigrams, task_terms, trigram_counts, trigram_rows
from cardloom.operators.overlap import EARLY, LEAST_POSTINGS, best_overlaps
from cardloom.schema import HIDDEN_SOURCES
from cardloom.sources.files import checkpoint

MIN_SHARED = 2
#: Terms of a bank that are carried to the scan; a larger bank joins the stored postings instead.
CARRIED_TERMS = 200_000
#: Distinct short queries that are looked for one by one in each text.
FEW_NEEDLES = 64
#: Segments that are told to the scan of texts, so that no others are dealt out.
FEW_HITS = 200_000
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


class Stored(Protocol):
    """Postings that are read for some terms at a time."""

    def frequency(self, terms: DataFrame) -> DataFrame: ...
    def rows(self, terms: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class PrunePolicy:
    """Keep at least ``typo_floor`` of the rarest present terms, then more while the scan costs less than the budget."""

    typo_floor: int = 6
    cost_budget: float = 0.0
    max_terms: int = 12
    cost_per_term: float = 0.0
    cost_per_df: float = 1.0


def query_terms(bank: DataFrame) -> DataFrame:
    """(query_id, term): distinct trigrams of each query."""
    return trigram_rows(bank.select(F.col("query_id").alias("seg_id"), "text")).withColumnRenamed("seg_id", "query_id")


def _carried(terms: DataFrame) -> frozenset[str] | None:
    """The distinct terms, or None for more than are carried to the scan."""
    rows = terms.select("term").distinct().limit(CARRIED_TERMS + 1).collect()
    return frozenset(r.term for r in rows) if len(rows) <= CARRIED_TERMS else None


def postings_for(terms: DataFrame, segments: DataFrame) -> DataFrame:
    """(seg_id, term) of the segments, for some terms."""
    few = _carried(terms)
    return trigram_rows(segments).join(terms.select("term").distinct(), "term", "left_semi") if few is None else trigram_rows(segments, few)


def _told(segments: DataFrame, few: frozenset[str]) -> DataFrame:
    return F.broadcast(segments.sparkSession.createDataFrame([(t,) for t in sorted(few)], "term string"))


def frequency(terms: DataFrame, segments: DataFrame, postings: DataFrame | Stored | None = None) -> DataFrame:
    """(term, df) of some terms, from postings or counted where texts are read."""
    if postings is not None:
        return document_frequency(postings) if isinstance(postings, DataFrame) else postings.frequency(terms)
    few = _carried(terms)
    return document_frequency(postings_for(terms, segments)) if few is None else trigram_counts(segments, few)


def carried_frequency(few: frozenset[str], segments: DataFrame, postings: DataFrame | Stored | None = None) -> dict[str, int]:
    """In how many segments each of a few terms is; those that are nowhere are left out."""
    if postings is None:
        counts = trigram_counts(segments, few)
    else:
        told = _told(segments, few)
        counts = document_frequency(postings.join(told, "term", "left_semi")) if isinstance(postings, DataFrame) else postings.frequency(told)
    return {r.term: r.df for r in counts.collect()}


def packed(terms: DataFrame, segments: DataFrame, postings: DataFrame | Stored | None = None) -> DataFrame:
    """(seg_id, note_id, held): the segments that hold any of the terms, and those one after the other."""
    rows = trigram_rows(segments) if postings is None else postings if isinstance(postings, DataFrame) else postings.rows(terms)
    held = rows.join(terms, "term", "left_semi").groupBy("seg_id").agg(F.array_join(F.collect_list("term"), "").alias("held"))
    return held.join(segments.select("seg_id", "note_id"), "seg_id").select("seg_id", "note_id", "held")


def hit_texts(rows: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """seg_id and some columns of the segments that the rows name. A number of them that can be told to the scan is, and then
    no other text is dealt out; rows are read for that, so they had better be stored."""
    some = rows.select("seg_id").distinct()
    few = some.limit(FEW_HITS + 1).count() <= FEW_HITS
    return segments.select("seg_id", *columns).join(F.broadcast(some) if few else some, "seg_id", "left_semi")


def document_frequency(postings: DataFrame) -> DataFrame:
    """(term, df): the number of segments that hold each term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def prune(terms: DataFrame, df: DataFrame, policy: PrunePolicy = PrunePolicy()) -> DataFrame:
    """(query_id, term, df): the kept terms of each query; absent terms have df 0 and are all kept."""
    known = terms.join(df, "term", "left").select("query_id", "term", F.coalesce("df", F.lit(0)).alias("df"))
    own = Window.partitionBy("query_id", F.col("df") > 0)
    order = own.orderBy("df", "term")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = known.withColumns({"at": F.row_number().over(order), "present": F.count("*").over(own), "total": F.sum("df").over(upto)})
    cost = F.lit(policy.cost_per_term) * F.col("at") + F.lit(policy.cost_per_df) * F.col("total")
    floor = F.least(F.lit(max(policy.typo_floor, MIN_SHARED)), F.col("present"))
    ends = (F.col("at") >= F.greatest(F.lit(policy.max_terms), floor)) | ((F.col("at") >= floor) & (cost >= policy.cost_budget))
    last = F.min(F.when(F.col("ends"), F.col("at"))).over(own)
    return ranked.withColumn("ends", ends).withColumn("last", last).where("df = 0 or last is null or at <= last").select("query_id", "term", "df")


def kept_of(present: list[tuple[int, str]], policy: PrunePolicy = PrunePolicy()) -> list[tuple[int, str]]:
    """``prune`` of one query's present terms (df, term), in order."""
    floor, total = min(max(policy.typo_floor, MIN_SHARED), len(present)), 0
    for at, (df, _) in enumerate(present, 1):
        total += df
        if at >= floor and (at >= policy.max_terms or policy.cost_per_term * at + policy.cost_per_df * total >= policy.cost_budget):
            return present[:at]
    return present


def pruned(bank: DataFrame, df: dict[str, int], policy: PrunePolicy = PrunePolicy()) -> DataFrame:
    """(query_id, held, size, floor): each query's kept terms that are anywhere, one after the other, how many, and the least
    overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, floor = [], [], []
            for texts in batch.column("texts").to_pylist():
                lows = [unicodedata.normalize("NFC", x).lower() for x in texts]
                own = {x[i : i + 3] for x in lows for i in range(len(x) - 2)}
                present = sorted((df[g], g) for g in own if g in df)
                kept = kept_of(present, policy)
                held.append("".join(g for _, g in kept))
                size.append(len(kept))
                floor.append(min(len(kept) + len(own) - len(present), MIN_SHARED))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(held, pa.string()), pa.array(size, pa.int64()), pa.array(floor, pa.int64())], names=["query_id", "held", "size", "floor"])

    texts = bank.groupBy("query_id").agg(F.collect_list("text").alias("texts"))
    return texts.mapInArrow(run, f"query_id {dict(bank.dtypes)['query_id']}, held string, size long, floor long").where("held <> ''")


def _held_terms(asked: DataFrame) -> frozenset[str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {x[i : i + 3] for batch in batches for x in batch.column("held").to_pylist() for i in range(0, len(x), 3)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], names=["term"])

    return frozenset(r.term for r in asked.select("held").mapInArrow(run, "term string").distinct().collect())


def _numbered(asked: DataFrame, terms: frozenset[str]) -> DataFrame:
    """The queries with their terms as ``packed_trigrams`` has them."""
    number = {t: i for i, t in enumerate(sorted(terms))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(number[x[i : i + 3]] for i in range(0, len(x), 3)) for x in batch.column("held").to_pylist()]
            of = np.repeat(np.arange(len(own)), [len(x) for x in own])
            held = coded(of, np.array([n for x in own for n in x], dtype=np.int64), len(own))
            yield batch.set_column(batch.schema.get_field_index("held"), "held", held)

    kinds = {**dict(asked.dtypes), "held": "binary"}
    return asked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in asked.columns))


def _early(segments: DataFrame) -> int | None:
    """The note up to which notes meet the queries first."""
    found = segments.select(F.col("note_id").cast("long")).approxQuantile("note_id", [EARLY], EARLY / 8)
    return min(int(found[0]), (1 << 63) - 1) if found else None


def fuzzy(bank: DataFrame, segments: DataFrame, top_k: int, scope: DataFrame | None = None, exclude: DataFrame | None = None, hidden: tuple[str, ...] = HIDDEN_SOURCES, policy: PrunePolicy = PrunePolicy(), postings: DataFrame | Stored | None = None) -> DataFrame:
    """(query_id, note_id, seg_id, overlap, rank): each query's best notes by their best segment.

    ``bank``: query_id, text. ``scope``: note_id of the notes that may answer (an empty table: none). ``exclude``: query_id,
    note_id; excluded notes leave the ranking after it is cut to top_k plus their number. Document frequencies are those of
    all segments, hidden and out of scope too, as terms are kept before notes are filtered.
    """
    few = _carried(task_terms(bank))
    if few is None:
        terms = query_terms(bank)
        kept = checkpoint(prune(terms, frequency(terms, segments, postings), policy))
        told = F.array_join(F.collect_list(F.when(F.col("df") > 0, F.col("term"))), "")
        asked = kept.groupBy("query_id").agg(F.least(F.count("*"), F.lit(MIN_SHARED)).alias("floor"), told.alias("held"), F.count(F.when(F.col("df") > 0, True)).alias("size")).where("held <> ''")
        some = kept.where("df > 0").select("term", "df").distinct()
        queries, size = kept.select("query_id").distinct().count(), some.agg(F.sum("df")).first()[0] or 0
    else:
        df = carried_frequency(few, segments, postings)
        asked = checkpoint(pruned(bank, df, policy))
        some = _held_terms(asked)
        queries, size = asked.count(), sum(df[t] for t in some)
    extra = None if exclude is None else exclude.groupBy("query_id").agg(F.count("*").alias("extra"))
    most = F.lit(max(top_k, 0)).cast("long")
    asked = asked.withColumn("most", most) if extra is None else asked.join(extra, "query_id", "left").withColumn("most", most + F.coalesce("extra", F.lit(0))).drop("extra")
    where = segments if not hidden else segments.where(~F.col("source").isin(*hidden))
    if scope is not None:
        where = where.join(scope.select("note_id"), "note_id", "left_semi")
    if few is None or postings is not None:
        best = best_overlaps(asked, packed(some.select("term").distinct() if few is None else _told(segments, some), where, postings), queries, size)
    else:
        early = _early(segments) if size >= 2 * LEAST_POSTINGS else None
        parts = [where] if early is None else [where.where(F.col("note_id") > early), where.where(F.col("note_id") <= early)]
        best = best_overlaps(_numbered(asked, some), packed_trigrams(parts[0], some), queries, size, *(packed_trigrams(p, some) for p in parts[1:]))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "note_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if exclude is None:
        return ranked.where(F.col("rank") <= top_k)
    cut = ranked.join(extra, "query_id", "left").where(F.col("rank") <= top_k + F.coalesce("extra", F.lit(0))).drop("extra")
    left = cut.join(exclude.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def containing(bank: DataFrame, segments: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, note_id, seg_id): all segments that hold a query's text as it stands, without any ranking.

    A segment that holds the text holds its rarest trigram, so only postings of that one are joined and only their texts are
    read. Queries of fewer than three characters have no trigram and no rows.
    """
    terms = query_terms(bank)
    known = terms.join(frequency(terms, segments, postings), "term", "left")
    rarest = checkpoint(known.groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term")))
    some = checkpoint(rarest.join(postings if postings is not None else postings_for(rarest, segments), "term").select("query_id", "seg_id"))
    texts = some.join(hit_texts(some, segments, "note_id", "text"), "seg_id").join(bank.select("query_id", F.col("text").alias("needle")), "query_id")
    return texts.where(F.contains("text", "needle")).select("query_id", "note_id", "seg_id")


def exact_of(fuzzy_rows: DataFrame, bank: DataFrame, segments: DataFrame, top_k: int | None = None) -> DataFrame:
    """(query_id, note_id, seg_id, tf, rank): fuzzy rows whose segment holds the query literally, most frequent first."""
    needle = bank.select("query_id", F.lower(F.trim(nfc("text"))).alias("needle")).where("needle <> ''")
    texts = fuzzy_rows.join(hit_texts(fuzzy_rows, segments, "text"), "seg_id").join(needle, "query_id")
    low = F.lower(F.col("text"))
    hits = texts.where(F.contains(low, F.col("needle"))).select("query_id", "note_id", "seg_id", (occurrences(low, F.col("needle")) / F.length("text")).alias("tf"))
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tf"), "note_id")))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def lexical_signals(fuzzy_rows: DataFrame, bank: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, note_id, seg_id, signal, rank): the fuzzy rows as ``exact`` and, the others, as ``fuzzy`` with ranks closed up.

    The same as ``exact_of`` and ``without_exact`` in one pass: texts are joined once and one window ranks both signals.
    """
    needle = bank.select("query_id", F.lower(F.trim(nfc("text"))).alias("needle"))
    low = F.lower(F.col("text"))
    rows = fuzzy_rows.join(hit_texts(fuzzy_rows, segments, "text"), "seg_id").join(needle, "query_id")
    tf = F.when((F.col("needle") != "") & F.contains(low, F.col("needle")), occurrences(low, F.col("needle")) / F.length("text"))
    rows = rows.select("query_id", "note_id", "seg_id", F.col("rank").alias("was"), tf.alias("tf")).withColumn("signal", F.when(F.col("tf").isNotNull(), "exact").otherwise("fuzzy"))
    order = Window.partitionBy("query_id", "signal").orderBy(F.desc_nulls_last("tf"), F.when(F.col("tf").isNull(), F.col("was")), "note_id")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "note_id", "seg_id", "signal", "rank")


def short_queries(bank: DataFrame) -> bool:
    """Whether any query is too short for trigrams."""
    return bool(bank.where("length(trim(text)) between 1 and 2").limit(1).count())


def without_exact(fuzzy_rows: DataFrame, exact_rows: DataFrame) -> DataFrame:
    """The fuzzy ranking without notes that are exact, ranks closed up."""
    left = fuzzy_rows.join(exact_rows.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def exact_fallback(bank: DataFrame, segments: DataFrame, top_k: int) -> DataFrame:
    """(query_id, note_id, seg_id, rank) for queries too short for trigrams: a scan for the literal, notes in id order.

    The first segment by ``ref`` answers for a note. A few distinct needles are looked for in each text; of more, each text's own
    windows of that length meet them, and no text meets a query it lacks. Of a needle only the first notes travel.
    """
    short = bank.select("query_id", F.lower(F.trim(nfc("text"))).alias("needle")).where("length(needle) between 1 and 2")
    needles = short.select("needle").distinct()
    few = [r.needle for r in needles.limit(FEW_NEEDLES + 1).collect()]
    where = segments.select("seg_id", "note_id", "ref", F.lower("text").alias("low"))
    if not few:
        found = where.select("seg_id", "note_id", "ref", F.lit("").alias("needle")).limit(0)
    elif len(few) <= FEW_NEEDLES:
        has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(n)), F.lit(n)) for n in few)))
        found = where.select("seg_id", "note_id", "ref", F.explode(has).alias("needle"))
    else:
        low = F.split("low", "")
        windows = F.array_distinct(F.concat(low, F.when(F.size(low) > 1, F.zip_with(F.slice(low, 1, F.size(low) - 1), F.slice(low, 2, F.size(low) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))))
        found = where.select("seg_id", "note_id", "ref", F.explode(windows).alias("needle")).join(needles, "needle", "left_semi")
    first = found.withColumn("at", F.dense_rank().over(Window.partitionBy("needle").orderBy("note_id"))).where(F.col("at") <= top_k)
    best = first.groupBy("needle", "note_id").agg(F.min(F.struct("ref", "seg_id")).alias("best")).join(short, "needle")
    out = best.select("query_id", "note_id", F.col("best.seg_id").alias("seg_id"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("note_id"))).where(F.col("rank") <= top_k)


def evidence(rows: DataFrame, bank: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows with source, ref, text and the byte span of the literal query, where it stands."""
    told = rows.join(hit_texts(rows, segments, "source", "ref", "text"), "seg_id").join(bank.select("query_id", F.col("text").alias("needle")), "query_id")
    return told.withColumn("span", byte_span("text", "needle")).drop("needle")


def fuzzy_span(text: str | None, query: str | None) -> tuple[int, int] | None:
    """From the first to the last window that text and query share, in UTF-8 bytes of the text."""
    text, low = text or "", (query or "").lower()
    own = {low[i : i + 3] for i in range(len(low) - 2)}
    hits = [i for i in range(len(text) - 2) if text[i : i + 3].lower() in own]
    return (len(text[: hits[0]].encode()), len(text[: hits[-1] + 3].encode())) if hits else None


@F.pandas_udf(_SPAN)
def matched_span(text: pd.Series, query: pd.Series) -> pd.DataFrame:
    """``fuzzy_span`` of columns, for hits alone."""
    spans = [fuzzy_span(t, q) or (None, None) for t, q in zip(text, query, strict=True)]
    return pd.DataFrame({"start": pd.array([s for s, _ in spans], dtype="Int32"), "end": pd.array([e for _, e in spans], dtype="Int32")})
