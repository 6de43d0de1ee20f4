"""Judges urls by rules and, where none fits, by what the link graph says of the host.

Trust flows along links from hosts with allowed pages, distrust flows backwards along
links from hosts with blocked pages (a page that links to spam is suspect). Both are
personalised PageRank over host edges, in DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import ascii_lower, store

#: (verdict, host and path)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
#: Rounds go on until what is still on its way is below this share of all seeds.
TOLERANCE = 1e-7
#: A host is blocked if (trust - distrust) / (trust + distrust) is below this.
THRESHOLD = 0.0
#: Rounds whose shares are added up together.
ADDED_TOGETHER = 8

#: A link with a host of its own; relative links stay on their host and carry nothing.
LINK = r"""href\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a parent domain and starts the path; else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    verdict = F.lit(None).cast("string")
    for kind, name in rules:
        verdict = F.when(rule == name, F.lit(kind)).otherwise(verdict)
    return verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links between two different hosts; counted before the shuffle."""
    links = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"),
    )
    return (
        links.withColumn("dst", ascii_lower(F.col("dst")))
        .where("src != '' AND dst != '' AND src != dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def _steps(edges: DataFrame) -> DataFrame:
    """For trust forward and distrust backward: where a host's score goes, and which share of it."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    )
    total = both.groupBy("kind", "host").agg(F.sum("links").alias("total"))
    return both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("total")).alias("share"))


def most_rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Each round passes on at most ``damping`` of what the one before did."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, score: personalised PageRank of ``seeds`` (kind, host, seed), up to ``tolerance`` of their sum.

    The score is a sum over rounds: what the seeds keep, what arrives over one link, over two, and
    so on. Only what arrived last is passed on, so hosts that nothing reaches any more cost nothing.
    """
    steps = store(_steps(edges), "link-steps")
    moving = store(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score")), "link-scores")
    whole = moving.agg(F.sum("score")).first()[0] or 0.0
    parts = [moving]
    for _ in range(most_rounds(damping, tolerance)):
        sent = moving.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        moving = store(sent.groupBy("kind", "host").agg(F.sum("score").alias("score")), "link-scores")
        mass = moving.agg(F.sum("score")).first()[0] or 0.0
        if not mass:
            break
        parts.append(moving)
        if len(parts) > ADDED_TOGETHER:
            parts = [store(_added(parts), "link-scores")]
        if mass < tolerance * whole:
            break
    return _added(parts)


def _added(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_score.

    Hosts with pages that a rule allows (blocks) are the seeds of trust (distrust), by their
    number of such pages; trust and distrust stay in pages, so that a host's own pages weigh alike
    whatever the share of blocked pages in the whole crawl. Without a fitting rule a page has its host's verdict: block when
    the score is below ``threshold``. A host that neither reaches has score 0. Null urls and
    urls without ``://`` have an empty host and path, and the empty host is never a seed.
    Repeated rows are judged alike; null html has no links.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("own", rule_verdict(F.col("rule"), rules))
    seeds = (
        judged.where("own IS NOT NULL AND host != ''")
        .groupBy(F.when(F.col("own") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count(F.lit(1)).cast("double").alias("seed"))
    )
    scores = propagate(seeds, host_edges(pages.select("url", "html")), damping, tolerance)
    trust, distrust = (F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)) for k in ("trust", "distrust"))
    hosts = scores.groupBy("host").agg(((trust - distrust) / (trust + distrust)).alias("host_score"))
    return judged.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", F.when(F.col("host_score") < threshold, "block").otherwise("allow")).alias("verdict"),
        F.round(F.coalesce("host_score", F.lit(0.0)), 6).alias("host_score"),
    )
