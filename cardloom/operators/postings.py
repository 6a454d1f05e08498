"""Stored postings: which segments hold each trigram, kept up by the changes of segments and read by searches.

The table is in buckets by term. A batch of changed segments adds one layer to the buckets of the terms that came or went;
buckets with many layers are folded. A search reads the buckets of its own terms and no text.

Files hold lists: of a term, the segments whose ids have equal upper 48 bits are one list of their lower 16, so a list is bounded
however frequent its term is. Tasks pack the texts that they read; what is shuffled and sorted are lists, two bytes a posting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.text import packed_postings
from cardloom.operators.fuzzy import query_terms
from cardloom.sources.buckets import Buckets

SCHEMA = "term string, seg_id long"
STORED = "term string, high long, lows array<smallint>"
#: Layers of a bucket beyond which it is folded.
MOST_LAYERS = 4


class Postings(Buckets):
    """Rows are (term, seg_id); files hold (term, high, lows)."""

    stored = STORED

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        return _unpacked(self._rows(version, buckets))

    def lists(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, high, lows) of some terms, from their buckets alone, or of all; every posting is in one list. Lists may be empty."""
        if terms is None:
            return self._rows()
        terms = terms.select("term").distinct()
        return self._rows(buckets=self.touched(terms), some=lambda rows: rows.join(terms, "term", "left_semi"))

    def rows(self, terms: DataFrame) -> DataFrame:
        """(term, seg_id) of some terms."""
        return _unpacked(self.lists(terms))

    def frequency(self, terms: DataFrame) -> DataFrame:
        """(term, df) of some terms."""
        return self.lists(terms).groupBy("term").agg(F.sum(F.size("lows").cast("long")).alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """(term, df, first_seg, last_seg, seg_sum): of each term's segments the number, least and greatest id, and sum."""
        size = F.size("lows").cast("long")
        low = F.aggregate("lows", F.lit(0).cast("long"), lambda s, x: s + x)
        at = F.col("high") * 65536 + 32768
        some = self._rows().select("term", size.alias("n"), (at + F.array_min("lows")).alias("first"), (at + F.array_max("lows")).alias("last"), (at * size + low).alias("sum"))
        return some.groupBy("term").agg(F.sum("n").alias("df"), F.min("first").alias("first_seg"), F.max("last").alias("last_seg"), F.sum("sum").alias("seg_sum")).where("df > 0")

    def _write(self, rows: DataFrame) -> dict[int, str]:
        if "seg_id" in rows.columns:
            keys = [*(c for c in ("term", "op") if c in rows.columns), F.shiftright("seg_id", 16).alias("high")]
            low = (F.col("seg_id").bitwiseAND(0xFFFF) - 0x8000).cast("smallint")
            rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(low)).alias("lows"))
        return super()._write(rows.where("size(lows) > 0"))

    def _folded(self, base: DataFrame, levels: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, [base.withColumns({"op": F.lit(1), "_at": F.lit(-1)}), *levels])
        own = lambda op, at: F.flatten(F.collect_list(F.when((F.col("op") == op) & (F.col("_at") == at), F.col("lows"))))
        parts = {"base": own(1, -1)} | {f"{name}{at}": own(op, at) for at in range(len(levels)) for name, op in (("came", 1), ("went", -1))}
        lows = F.col("base")
        for at in range(len(levels)):
            left = F.when(F.size(f"went{at}") > 0, F.array_except(lows, f"went{at}")).otherwise(lows)
            lows = F.when(F.size(f"came{at}") > 0, F.array_union(left, f"came{at}")).otherwise(left)
        return every.groupBy("term", "high").agg(*(c.alias(name) for name, c in parts.items())).select("term", "high", lows.alias("lows"))  # a filter here would fold twice


def _packed(segments: DataFrame) -> DataFrame:
    """(term, high, lows) of segments (seg_id, text); a term may have several lists of the same upper bits."""
    return segments.where("seg_id is not null").select(F.col("seg_id").cast("long"), "text").mapInArrow(packed_postings, STORED)


def _unpacked(lists: DataFrame) -> DataFrame:
    """(term, seg_id)"""
    return lists.select("term", "high", F.explode("lows").alias("low")).select("term", (F.col("high") * 65536 + 32768 + F.col("low")).alias("seg_id"))


def store(spark: SparkSession, folder: str, n: int = 64) -> Postings:
    """The stored postings in a folder; ``n`` buckets if they are new."""
    return Postings(spark, folder, ["term"], SCHEMA, n)


def build(held: Postings, segments: DataFrame, note: dict | None = None) -> int:
    """Postings of all segments (seg_id, text); the version."""
    return held.write(_packed(segments), note)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(term, high, lows, op): postings that lead from the segments' old texts to the new; what both have is left alone.

    A segment that is in ``before`` alone goes, one in ``after`` alone comes.
    """
    both = _packed(after).withColumn("op", F.lit(1)).unionByName(_packed(before).withColumn("op", F.lit(-1)))
    own = lambda op: F.flatten(F.collect_list(F.when(F.col("op") == op, F.col("lows"))))
    sides = both.groupBy("term", "high").agg(own(1).alias("came"), own(-1).alias("went"))
    made = F.array(*(F.struct(F.array_except(a, b).alias("lows"), F.lit(op).alias("op")) for a, b, op in (("came", "went", 1), ("went", "came", -1))))
    return sides.select("term", "high", F.explode(made).alias("made")).select("term", "high", "made.lows", "made.op").where("size(lows) > 0")


def update(held: Postings, before: DataFrame, after: DataFrame, note: dict | None = None, most: int = MOST_LAYERS) -> int:
    """Bring the postings from the segments' old texts to the new; the version. ``before`` and ``after`` (seg_id, text) hold
    the segments that a batch touches and no others."""
    version = held.change(changes(before, after), note)
    return max(version, held.compact(most))


def lookup(held: Postings, bank: DataFrame) -> DataFrame:
    """(term, seg_id) of the terms of a bank (query_id, text), from their buckets alone."""
    return held.rows(query_terms(bank))
