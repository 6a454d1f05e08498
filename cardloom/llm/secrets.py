"""Secret scans with multipart credential linking, in built-in functions alone (operator 10).

Each kind of span is found once per text: the lengths of matches and of what stands between them give every position by
running sums over the text's rows. On top of the base kinds, weak candidates are looked for which alone say little: bare
strings of many different characters (``part``), account or client identifiers (``ident``) and endpoints (``endpoint``). An
interval join within the document, bounded by a scope in code points, reports a weak candidate only where complementary
parts co-occur: a part needs an identifier (weak or an access key) or an endpoint nearby, an identifier or an endpoint needs
a secret (a part, an assignment or a hex key). The join is a sweep over the document's spans in order, so it is linear in
them. What stands in a URL's path up to its query is no part: it is public and would always have its own endpoint nearby.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base kinds, in the order in which spans of one start are listed: pattern, group that is measured, its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Kinds that count in company only.
WEAK = {
    "part": (r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    "ident": (r"((?i:user(?:name)?|login|client_?id|account_?id|key_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", 2, 3),
    "endpoint": (r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 8),
}
#: Rules out parts within it, and is never reported.
RULING = {"path": (r"""[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?/[^\x20\x09-\x0D?#"'<>]*""", 0, 1)}
#: Different characters of a part, which also has a digit, a capital and a small letter.
STRONG = 16
#: Cheap tests that every match passes, before the full patterns run.
_HINT = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "access": "AKIA",
    "hex": r"[0-9a-f]{24}",
    "part": r"[A-Za-z0-9+/]{32}",
    "ident": r"(?i:user|login|client_?id|account_?id|key_?id)",
    "endpoint": "://",
    "path": "://",
}
_SECRETS, _IDENTS, _ENDPOINTS = ("assign", "hex", "part"), ("access", "ident"), ("endpoint",)
#: Code points between parts that can belong together.
SCOPE = 200


def _strong(match: Column) -> Column:
    return (F.size(F.array_distinct(F.split(match, ""))) >= STRONG) & match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")


def matches(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Array of (rank, kind, at, step, length, counts): the pattern's leftmost matches in order, each with the code points
    from the end of the one before to its own end, and whether it counts. One projection, linear in the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    each = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("match"), held.alias("held")),
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            i.alias("at"),
            (F.length(x["gap"]) + F.length(x["match"])).alias("step"),
            F.length(x["match"]).alias("length"),
            ((F.length(x["held"]) >= least) & (_strong(x["match"]) if kind == "part" else F.lit(True))).alias("counts"),
        ),
    )
    return F.when(text.rlike(_HINT[kind]), each).otherwise(F.array().cast("array<struct<rank:int,kind:string,at:int,step:int,length:int,counts:boolean>>"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Base spans always stay. Weak spans that a base span contains are left out, and so are parts within a URL's path; the rest
    follow the linking rule above. Spans are in code points, end exclusive. A null text is empty and has no spans; texts of any
    length are searched whole, with a row per match. Null ids and repeated rows give rows of their own, as each row is told
    apart by a number of its own; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {**BASE, **WEAK, **RULING}
    found = F.concat(*(matches(F.col("text"), kind, *rule, rank) for rank, (kind, rule) in enumerate(kinds.items())))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row")).select("row", "doc_id", found.alias("found"))
    # one exchange by row serves the running sums, the sweep and the sums per document
    rows = rows.select("row", "doc_id", F.explode_outer("found").alias("m")).select("row", "doc_id", "m.*").repartition("row")
    end = F.sum("step").over(Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    parts = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    order = Window.partitionBy("row").orderBy("start", "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows is what precedes in reverse: a frame that grows backwards would be summed anew for each row
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"))))

    def near(names: tuple[str, ...]) -> Column:
        """A span of these kinds whose gap to this one is within the scope."""
        of = F.col("kind").isin(*names)
        behind = F.max(F.when(of, F.col("end"))).over(before)
        ahead = F.min(F.when(of, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - behind <= scope, F.lit(False)) | F.coalesce(ahead - F.col("end") <= scope, F.lit(False))

    # matches that don't count, and documents without any, stay as rows without a kind
    counted, is_base = parts.where("rank is null or counts or at = 0"), F.col("rank") < len(BASE)
    base_end, path_end = (F.max(F.when(of & F.col("counts"), F.col("end"))).over(upto) for of in (is_base, F.col("kind") == "path"))
    inside = F.coalesce(base_end >= F.col("end"), F.lit(False)) | ((F.col("kind") == "part") & F.coalesce(path_end >= F.col("end"), F.lit(False)))
    free = counted.withColumn("free", F.col("counts") & (is_base | ~inside) & (F.col("kind") != "path"))
    free = free.withColumns({"kind": F.when(F.col("free"), F.col("kind")), "s": F.when(F.col("free"), F.struct("start", "rank", "kind", "end"))})
    linked = free.withColumns({"secret": near(_SECRETS), "named": near(_IDENTS), "placed": near(_ENDPOINTS)})
    base = F.col("kind").isin(*BASE)
    reported = base | F.when(F.col("kind") == "part", F.col("named") | F.col("placed")).when(F.col("kind").isin(*_IDENTS, *_ENDPOINTS), F.col("secret")).otherwise(F.lit(False))
    merged = linked.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count_if(F.col("kind") == kind).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.array_sort(F.collect_list(F.when(base, F.col("s")))).alias("base"),
        F.array_sort(F.collect_list(F.when(reported, F.col("s")))).alias("every"),
    )
    return merged.select("doc_id", *(f"n_{kind}" for kind in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_linked"))
