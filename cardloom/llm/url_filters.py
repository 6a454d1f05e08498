"""URL filters: rules first, then trust and distrust spread over the graph of hosts (operator 5).

A host's share of pages that rules allow is its trusted seed, the share that they block its distrusted seed. Trust is a
personalised PageRank: it flows along links from trusted hosts. Distrust flows against links, so who links to blocked
hosts is distrusted. Both are computed over weighted host edges by joins on hosts; a host whose distrust exceeds its trust
and a threshold is blocked. Pages of hosts that no rule decides take their host's verdict.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import checkpoint

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, ROUNDS = 0.85, 10
#: Of the greatest distrust that seeds alone can give.
THRESHOLD = 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, _URL, 1)), F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as its text, and its verdict; null if none does.

    ``rules`` is a list of moderate length (hundreds), as it becomes one expression.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links between different hosts, each host's shares adding up to 1."""
    host, _ = split_url(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst")).select("src", _lower(F.col("dst")).alias("dst"))
    counts = links.where("src <> '' and src <> dst").groupBy("src", "dst").count()
    totals = counts.groupBy("src").agg(F.sum("count").alias("total"))
    return counts.join(totals, "src").select("src", "dst", (F.col("count") / F.col("total")).alias("share"))


def spread(seeds: DataFrame, edges: DataFrame, source: str, target: str, damping: float, rounds: int) -> DataFrame:
    """(host, score) after ``rounds`` steps of score = (1 - damping) * seed + damping * sum(share * score at ``source``)."""
    own = seeds.where("seed > 0").select("host", (F.col("seed") * (1 - damping)).alias("score"))
    now = own
    for step in range(rounds):
        flow = edges.join(now, edges[source] == now.host).groupBy(F.col(target).alias("host")).agg(F.sum(F.col("share") * F.col("score") * damping).alias("score"))
        now = own.unionByName(flow).groupBy("host").agg(F.sum("score").alias("score"))
        if step % 4 == 3:
            now = checkpoint(now)
    return now


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    ``pages`` has page_id, url and html. A null url has empty host and path, fits no rule, and is allowed, as are hosts that
    nothing is known of. A null html has no links. Repeated rows count as pages of their own; other columns aren't read.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": name, "ruled": verdict})
    share = lambda what: (F.count_if(F.col("ruled") == what) / F.count("*")).alias(what)
    seeds = checkpoint(ruled.where("host <> ''").groupBy("host").agg(share("allow"), share("block")))
    edges = checkpoint(host_edges(pages))
    steps = rounds if edges.limit(1).count() else 0  # without links, seeds are the whole answer
    trust = spread(seeds.select("host", F.col("allow").alias("seed")), edges, "src", "dst", damping, steps)
    distrust = spread(seeds.select("host", F.col("block").alias("seed")), edges, "dst", "src", damping, steps)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    held = ruled.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - damping))
    return held.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
