"""Rollups and statistics of a collection, and measures of search quality and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.tags import prefixes

SECTIONS = ("summary", "note_types", "decks", "tags", "stats")


def deck_note_counts(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """(name, notes): distinct notes of each deck and those below it, by current and original deck; 0 where there are none.

    Distinct counts are two partial aggregates: pairs once, then their number.
    """
    both = cards.select("note_id", "deck_id").unionByName(cards.where("original_deck_id <> 0").select("note_id", F.col("original_deck_id").alias("deck_id")))
    pairs = both.distinct().join(decks, "deck_id").select("note_id", F.explode(prefixes("name")).alias("name")).distinct()
    counts = pairs.groupBy("name").agg(F.count("*").alias("notes"))
    return decks.select("name").join(counts, "name", "left").select("name", F.coalesce("notes", F.lit(0)).alias("notes"))


def deck_due_counts(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """(name, due, new): cards to learn or review, and new ones, of each deck and those below it."""
    own = cards.join(decks, "deck_id").select(F.explode(prefixes("name")).alias("name"), "queue")
    counts = own.groupBy("name").agg(F.count_if(F.col("queue").isin("learn", "review", "due")).alias("due"), F.count_if(F.col("queue") == "new").alias("new"))
    return decks.select("name").join(counts, "name", "left").na.fill(0, ["due", "new"])


def summary(notes: DataFrame, cards: DataFrame, decks: DataFrame, types: DataFrame, registry: DataFrame) -> DataFrame:
    """One row of totals; due counts cards of top-level decks, which hold those of all below."""
    due = deck_due_counts(cards, decks).where(~F.contains("name", F.lit("::"))).agg(F.coalesce(F.sum("due"), F.lit(0)).alias("due"), F.coalesce(F.sum("new"), F.lit(0)).alias("new"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(notes, "notes").join(one(cards, "cards")).join(one(decks, "decks")).join(one(types, "note_types")).join(one(registry.distinct(), "tags")).join(due)
    return out.join(notes.agg(F.max("modified").alias("modified")))


def deck_stats(notes: DataFrame, cards: DataFrame, decks: DataFrame) -> DataFrame:
    """(name, notes, due, new) of each deck."""
    return deck_note_counts(cards, decks).join(deck_due_counts(cards, decks), "name")


def note_type_list(types: DataFrame, detail: bool = False) -> DataFrame:
    rows = types.select("name", "type_id", F.when(F.col("kind") == "cloze", "cloze").otherwise("standard").alias("kind"), *(["fields", "templates", "css"] if detail else []))
    return rows.orderBy("name")


def sections(asked: list[str] | None) -> list[str]:
    """The sections to tell: the summary by default, all five for ``all``."""
    asked = asked or ["summary"]
    if "all" in asked:
        return list(SECTIONS)
    if unknown := [s for s in asked if s not in SECTIONS]:
        raise ValueError(f"unknown sections {unknown}")
    return [s for s in SECTIONS if s in asked]


def use_counts(notes: DataFrame, cards: DataFrame, decks: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes of each type, and cards of each deck family (by current or original deck)."""
    by_type = types.select("name").join(notes.groupBy(F.col("note_type").alias("name")).agg(F.count("*").alias("notes")), "name", "left").na.fill(0, ["notes"])
    both = cards.select("card_id", "deck_id").unionByName(cards.where("original_deck_id <> 0").select("card_id", F.col("original_deck_id").alias("deck_id"))).distinct()
    family = both.join(decks, "deck_id").select("card_id", F.explode(prefixes("name")).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("cards"))
    return by_type, decks.select("name").join(family, "name", "left").na.fill(0, ["cards"])


def ir_metrics(returned: DataFrame, gold: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """One row per query of (query_id): recall at 1, 5 and k, hit at k, MRR, nDCG at 10, P at k, false positives, over-return.

    ``returned``: query_id, note_id, rank, and is_exact where known; ``gold``: query_id, note_id, grade (2 and more are
    relevant). Measures without relevant gold, or without returned notes, are null.
    """
    judged = returned.join(gold, ["query_id", "note_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("rank", "note_id")
    judged = judged.withColumn("at", F.row_number().over(order))
    relevant, within = F.col("grade") >= 2, lambda k: F.col("at") <= k
    gain = F.when(within(10), F.greatest("grade", F.lit(0)) / F.log2(F.col("at") + 1))
    is_exact = F.col("is_exact") if "is_exact" in returned.columns else F.lit(False)
    own = judged.groupBy("query_id").agg(
        F.count("*").alias("returned"),
        *(F.count_if(relevant & within(k)).alias(f"found_{name}") for name, k in (("1", 1), ("5", 5), ("k", top_k))),
        F.min(F.when(relevant, F.col("at"))).alias("first"),
        F.sum(gain).alias("dcg"),
        F.count_if(F.col("grade") == 0).alias("wrong"),
        F.count_if(is_exact).alias("exact"),
        F.count_if(is_exact & (F.col("grade") == 0)).alias("exact_wrong"),
    )
    ideal = gold.where("grade > 0").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "note_id"))).where("at <= 10")
    best = ideal.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("at") + 1)).alias("idcg"))
    size = gold.groupBy("query_id").agg(F.count_if(F.col("grade") >= 2).alias("relevant"), F.count("*").alias("graded"))
    rows = queries.select("query_id").join(own, "query_id", "left").join(best, "query_id", "left").join(size, "query_id", "left")
    rows = rows.na.fill(0, ["returned", "found_1", "found_5", "found_k", "wrong", "exact", "exact_wrong", "relevant", "graded"]).na.fill(0.0, ["dcg"])
    some = F.col("relevant") > 0
    return rows.select(
        "query_id", "returned",
        *(F.when(some, F.col(f"found_{x}") / F.col("relevant")).alias(f"recall_at_{x}") for x in ("1", "5", "k")),
        F.when(some, F.when(F.col("found_k") > 0, 1.0).otherwise(0.0)).alias("hit_at_k"),
        F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some, F.when(F.coalesce("idcg", F.lit(0.0)) == 0, 1.0).otherwise(F.col("dcg") / F.col("idcg"))).alias("ndcg_at_10"),
        F.when(F.col("returned") > 0, F.col("found_k") / F.least("returned", F.lit(top_k))).alias("precision_at_k"),
        F.when(F.col("returned") > 0, F.col("wrong") / F.col("returned")).otherwise(0.0).alias("false_positive_rate"),
        ((F.col("graded") == 0) & (F.col("returned") > 0)).alias("over_returned"),
        F.when(F.col("exact") > 0, F.col("exact_wrong") == 0).alias("exact_tier_pure"),
    )


def latency_distribution(samples: DataFrame, group: str, value: str = "seconds", at: str = "at") -> DataFrame:
    """(group, n, min, mean, max, p50, p90, p99, drift): drift is the later half's median less the earlier half's."""
    order, every = Window.partitionBy(group).orderBy(at), Window.partitionBy(group)
    half = samples.withColumns({"i": F.row_number().over(order), "of": F.count("*").over(every)}).withColumn("early", F.col("i") <= F.floor(F.col("of") / 2))
    p = lambda x: F.percentile(value, F.lit(x))
    median = lambda side: F.percentile(F.when(side, F.col(value)), F.lit(0.5))
    return half.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), (median(~F.col("early")) - median(F.col("early"))).alias("drift"))


def index_status(vectors: DataFrame) -> DataFrame:
    """(modality, vectors, notes, ndim)."""
    return vectors.groupBy("modality").agg(F.count("*").alias("vectors"), F.countDistinct("note_id").alias("notes"), F.max(F.size("vec")).alias("ndim"))


def coverage_matrix(spaces: DataFrame, derived: DataFrame) -> DataFrame:
    """(query, target, status) over text, image and audio.

    ``spaces``: space, modality; ``derived``: modality of which a ready recogniser makes text. ``native``: one space holds
    both; ``via_derived_text``: the query and text are served and text is derived of the target; else ``unavailable``.
    """
    spark = spaces.sparkSession
    kinds = spark.createDataFrame([("text",), ("image",), ("audio",)], "m string")
    grid = kinds.select(F.col("m").alias("query")).join(kinds.select(F.col("m").alias("target")))
    native = spaces.alias("a").join(spaces.alias("b"), "space").select(F.col("a.modality").alias("query"), F.col("b.modality").alias("target"), F.lit(True).alias("native")).distinct()
    served = spaces.select(F.col("modality").alias("query"), F.lit(True).alias("served")).distinct()
    text = spaces.where("modality = 'text'").agg((F.count("*") > 0).alias("text"))
    made = derived.select(F.col("modality").alias("target"), F.lit(True).alias("made")).distinct()
    rows = grid.join(native, ["query", "target"], "left").join(served, "query", "left").join(made, "target", "left").join(text)
    return rows.select("query", "target", F.when(F.col("native"), "native").when(F.col("served") & F.col("text") & F.col("made"), "via_derived_text").otherwise("unavailable").alias("status"))
