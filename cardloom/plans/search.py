"""Fused search of a whole query bank as one lazily built plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import byte_span
from cardloom.operators import fuse, fuzzy, knn, tags
from cardloom.operators.postings import Postings
from cardloom.sources.files import checkpoint

ALL = 1_000_000_000
MOST_QUERIES = 50


@dataclass(frozen=True)
class Index:
    """The derived tables that a search reads. Those that are missing leave their signals out; without postings, stored ones
    (of which a search reads the buckets of its terms) or a table, texts are scanned for the terms."""

    segments: DataFrame
    vectors: DataFrame | None = None
    members: DataFrame | None = None
    centroids: DataFrame | None = None
    postings: DataFrame | Postings | None = None
    image_floor: float | None = None
    version: int = 0
    spaces: dict[str, DataFrame] = field(default_factory=dict)


def gate(queries: list[str], anchor_ids: list[int], mode: str = "fused") -> tuple[bool, str | None]:
    """Whether meaning is searched too, and what to say if not: short queries alone, or lexical mode, search letters."""
    if mode not in ("fused", "lexical"):
        raise ValueError(f"unknown mode {mode!r}")
    if len(queries) > MOST_QUERIES or len(anchor_ids) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries or anchors")
    if not queries and not anchor_ids:
        raise ValueError("a query or an anchor is needed")
    if mode == "lexical":
        return False, None
    if not anchor_ids and all(len(q.strip()) < 3 for q in queries):
        return False, "Queries of fewer than three characters are searched literally."
    return True, None


def stale(start: int, end: int, settled_start: bool = True, settled_end: bool = True) -> bool:
    """Whether a search may have read tables of different times."""
    return start != end or not settled_start or not settled_end


def search(bank: DataFrame, index: Index, top_k: int = 10, query_vectors: DataFrame | None = None, scope: DataFrame | None = None, exclude: DataFrame | None = None, threshold: float = 0.5, weights: dict[str, float] | None = None, evidence: bool = True) -> DataFrame:
    """(query_id, rank, note_id, score, semantic, signals, substring, fuzzy): the fused hits of each query of the bank.

    ``bank``: query_id, text; ``query_vectors``: query_id, vec. Signals: ``text`` and ``image`` (vectors by modality), ``tag``,
    ``exact`` (its own tier) and ``fuzzy`` (what isn't exact). ``semantic`` is the greatest similarity that text or image has;
    null where letters alone found the note. Texts are joined to the hits only, for the byte spans that show why.
    """
    top_k = top_k or ALL
    near = checkpoint(fuzzy.fuzzy(bank, index.segments, top_k, scope, exclude, postings=index.postings))
    lexical = fuzzy.lexical_signals(near, bank, index.segments)
    if fuzzy.short_queries(bank):
        where = index.segments.where(~F.col("source").isin(*fuzzy.HIDDEN_SOURCES))
        if scope is not None:
            where = where.join(scope.select("note_id"), "note_id", "left_semi")
        short = fuzzy.exact_fallback(bank, where, top_k).withColumn("signal", F.lit("exact"))
        if exclude is not None:
            short = short.join(exclude.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")
        lexical = lexical.unionByName(short)
    lexical = checkpoint(lexical)
    rankings = [lexical.select("query_id", "signal", "note_id", "rank")]
    scores = None
    if query_vectors is not None and index.vectors is not None:
        for modality in ("text", "image"):
            own = index.vectors.where(F.col("modality") == modality)
            judged = {"threshold": threshold} if modality == "text" else {"threshold": None, "floor": index.image_floor}
            hits = knn.semantic(query_vectors, own, top_k, scope=scope, exclude=exclude, **judged)
            rankings.append(hits.select("query_id", F.lit(modality).alias("signal"), "note_id", "rank"))
            some = hits.select("query_id", "note_id", "score")
            scores = some if scores is None else scores.unionByName(some)
        if index.centroids is not None and index.members is not None:
            tagged = tags.tag_signal(query_vectors, index.centroids, index.members, index.vectors.where("modality = 'text'"))
            if scope is not None:
                tagged = tagged.join(scope, "note_id", "left_semi")
            if exclude is not None:
                tagged = tagged.join(exclude.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")
            rankings.append(tagged.select("query_id", F.lit("tag").alias("signal"), "note_id", "rank"))
    every = rankings[0]
    for ranking in rankings[1:]:
        every = every.unionByName(ranking)
    fused = fuse.rrf(every, weights, top_k=top_k)
    if scores is None:
        out = fused.withColumn("semantic", F.lit(None).cast("double"))
    else:
        out = fused.join(scores.groupBy("query_id", "note_id").agg(F.max("score").alias("semantic")), ["query_id", "note_id"], "left")
    columns = ["query_id", "rank", "note_id", "score", "semantic", "signals"]
    if not evidence:
        return out.select(columns)
    found = lexical.select("query_id", "note_id", "seg_id", F.when(F.col("signal") == "exact", "substring").otherwise("fuzzy").alias("how"))
    told = found.join(out.select("query_id", "note_id"), ["query_id", "note_id"], "left_semi").join(fuzzy.hit_texts(lexical, index.segments, "source", "ref", "text"), "seg_id").join(bank.select("query_id", F.col("text").alias("needle")), "query_id")
    told = told.withColumns({"literal": byte_span("text", "needle"), "shared": fuzzy.matched_span("text", "needle")})
    shown = {how: F.struct("source", "ref", "text", F.col(span).alias("span")) for how, span in (("substring", "literal"), ("fuzzy", "shared"))}
    kinds = told.groupBy("query_id", "note_id").agg(*(F.first(F.when(F.col("how") == how, s), ignorenulls=True).alias(how) for how, s in shown.items()))
    return out.join(kinds, ["query_id", "note_id"], "left").select(*columns, "substring", "fuzzy")
