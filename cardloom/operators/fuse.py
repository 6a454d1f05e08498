"""Reciprocal Rank Fusion with a priority tier, and the fusion of several vector spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.vectors import sigmoid

RRF_K = 60
WEIGHTS = {"text": 1.0, "image": 1.0, "tag": 1.0, "exact": 1.0, "fuzzy": 0.5}
PRIORITY = ("exact",)
RELATIVE_MODES = ("relative", "relative_floor", "soft_relative", "soft_calibrated")
MODES = (*RELATIVE_MODES, "floor_admit", "floor_admit_budget", "soft_floor_admit", "soft_floor_admit_budget")


def rrf(rankings: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, priority: tuple[str, ...] = PRIORITY, top_k: int | None = None, own_weights: DataFrame | None = None) -> DataFrame:
    """(query_id, note_id, score, tier, signals, rank) of (query_id, signal, note_id, rank).

    A note counts once per signal, at its best rank. Scores add up in the order of signal names, as floating-point sums
    depend on it: ``sum`` wouldn't do. Signals without a weight, and weights that aren't finite, have 1. ``own_weights``
    (query_id, signal, weight) go before ``weights``. ``signals`` lists what found the note, best rank first.
    """
    known = F.lit(1.0)
    for signal, weight in (WEIGHTS if weights is None else weights).items():
        known = F.when(F.col("signal") == signal, F.lit(float(weight))).otherwise(known)
    best = rankings.groupBy("query_id", "signal", "note_id").agg(F.min("rank").cast("long").alias("rank")).withColumn("weight", known)
    if own_weights is not None:
        own = own_weights.select("query_id", "signal", F.col("weight").alias("own"))
        best = best.join(own, ["query_id", "signal"], "left").withColumn("weight", F.coalesce("own", "weight")).drop("own")
    finite = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") != float("inf"))
    best = best.withColumn("weight", F.when(finite, F.col("weight")).otherwise(F.lit(1.0)))
    parts = F.array_sort(F.collect_list(F.struct("signal", "rank", "weight")))
    fused = best.groupBy("query_id", "note_id").agg(parts.alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["weight"] / (F.lit(k) + p["rank"]).cast("double"))
    tier = F.when(F.exists("parts", lambda p: p["signal"].isin(*priority)), F.lit(0)).otherwise(F.lit(1)) if priority else F.lit(1)
    signals = F.array_sort(F.transform("parts", lambda p: F.struct(p["rank"].alias("rank"), p["signal"].alias("signal"))))
    out = fused.select("query_id", "note_id", score.alias("score"), tier.alias("tier"), signals.alias("signals"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "note_id")))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def cross_space(hits: DataFrame, floors: DataFrame, primary: DataFrame, mode: str = "floor_admit", tau: float = 0.05, budget: float = 1.0, gate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rankings (query_id, signal ``image#<space>``, note_id, score, rank) of further image spaces, and their weights.

    ``hits``: query_id, space, note_id, score (image similarity), best (the space's best similarity for the query, over its
    modalities); ``floors``: space, floor (null: not calibrated); ``primary``: query_id, best of the text space.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    rows = hits.join(floors, "space", "left").join(primary.select("query_id", F.col("best").alias("primary_best")), "query_id", "left")
    if mode in RELATIVE_MODES and gate:
        rows = rows.where("best is not null and (primary_best is null or best >= primary_best)")
    if mode.startswith("floor_admit"):
        rows = rows.where("floor is null or score > floor")
    order = Window.partitionBy("query_id", "space").orderBy(F.desc("score"), "note_id")
    rows = rows.withColumns({"rank": F.row_number().over(order), "image_best": F.max("score").over(Window.partitionBy("query_id", "space"))})
    if mode == "relative_floor":
        rows = rows.where("floor is null or image_best > floor")
    weight = F.lit(1.0)
    if mode == "soft_relative" and tau > 0:
        weight = F.coalesce(sigmoid((F.col("best") - F.col("primary_best")) / tau), F.lit(1.0))
    elif mode in ("soft_calibrated", "soft_floor_admit", "soft_floor_admit_budget") and tau > 0:
        weight = F.coalesce(sigmoid((F.col("image_best") - F.col("floor")) / tau), F.lit(1.0))
    rows = rows.withColumns({"signal": F.concat(F.lit("image#"), "space"), "weight": weight})
    weights = rows.where("rank = 1").select("query_id", "signal", "weight")
    if mode.endswith("_budget"):
        every = Window.partitionBy("query_id")
        weights = weights.withColumns({"total": F.sum("weight").over(every), "n": F.count("*").over(every)})
        weights = weights.withColumn("weight", F.when((F.col("n") >= 2) & (F.col("total") > budget), F.col("weight") * (F.lit(budget) / F.col("total"))).otherwise(F.col("weight")))
    return rows.select("query_id", "signal", "note_id", "score", "rank"), weights.select("query_id", "signal", "weight")
