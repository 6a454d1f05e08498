"""The stored test tables as the engine's own: documents and customers as notes, orders as cards, nations as decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_notes(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = docs.join(labels, "doc_id", "left")
    tags = F.filter(F.array(F.concat_ws("::", F.lit("lang"), "lang"), F.concat_ws("::", F.lit("src"), "source"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "flag::toxic")), lambda t: t.isNotNull())
    fields = F.array(F.struct(F.lit(0).alias("ord"), F.lit("Text").alias("name"), F.col("text").alias("value")))
    return joined.select(F.col("doc_id").alias("note_id"), F.lit("Basic").alias("note_type"), F.concat_ws("::", "lang", "source").alias("deck"), tags.alias("tags"), fields.alias("fields"))


def document_segments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("seg_id"), F.col("doc_id").alias("note_id"), F.lit("field").alias("source"), F.lit("Text").alias("ref"), "text")


def conversation_segments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg_id"), F.col("conv_id").alias("note_id"), F.when(F.col("role") == "system", "vlm").otherwise("field").alias("source"), F.col("turn").cast("string").alias("ref"), "text")


def benchmark_bank(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.lit("primary").alias("space"), F.lit("text").alias("modality"), F.col("vec_id").alias("note_id"), F.lit(0).alias("item"), F.col("embedding").alias("vec"), "label")


def nation_decks(spark: SparkSession, folder: str) -> DataFrame:
    """Regions and, below each, its nations; ids of regions are negative."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    below = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("long").alias("deck_id"), F.concat_ws("::", "r_name", "n_name").alias("name"))
    return below.unionByName(region.select((-F.col("r_regionkey") - 1).cast("long").alias("deck_id"), F.col("r_name").alias("name")))


def order_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as cards of customers: decks by the customer's nation, original decks by the priority's first digit."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    queue = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "learn").otherwise("review")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("note_id"), F.lit(0).alias("ord"), F.col("c_nationkey").cast("long").alias("deck_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("original_deck_id"), queue.alias("queue"),
    )


def customer_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as notes: the deck is their nation's, modified is their last order's date."""
    customer, decks = table(spark, folder, "customer"), nation_decks(spark, folder)
    last = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("modified"))
    fields = F.array(F.struct(F.lit(0).alias("ord"), F.lit("Name").alias("name"), F.col("c_name").alias("value")), F.struct(F.lit(1).alias("ord"), F.lit("Balance").alias("name"), F.col("c_acctbal").cast("string").alias("value")))
    joined = customer.join(decks, customer.c_nationkey.cast("long") == decks.deck_id).join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    kind = F.when(F.col("c_acctbal") < 0, "Cloze").otherwise("Basic")
    return joined.select(F.col("c_custkey").alias("note_id"), F.sha2("c_name", 256).alias("guid"), kind.alias("note_type"), F.col("name").alias("deck"), F.array(F.concat(F.lit("segment::"), F.lower("c_mktsegment"))).alias("tags"), "modified", fields.alias("fields"))


def event_changes(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "Remove").when(F.col("event_type") == "click", "AdvanceOnly").otherwise("Maintain")
    return table(spark, folder, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("col_mod"), kind.alias("kind"), (F.col("event_type") != "error").alias("success"), (F.col("event_type") == "signup").alias("clear"), "ts", "value")
