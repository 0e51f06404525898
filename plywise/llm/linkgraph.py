"""URL filters: rules by host and path, and elsewhere trust and distrust that spread over the graph of linked hosts.

Links of all pages are counted by pair of hosts (with partial sums, so a page's host that has most of the rows is one
edge to each host it links to). Hosts that the rules judge are seeds: trusted ones if most of their judged pages are
allowed, blocked ones if not. Trust is a personalised PageRank from the trusted seeds along the links; distrust is one
from the blocked seeds against them, so that it reaches those who link to blocked hosts. A page without a rule is blocked
if its host has more distrust than trust, and at least ``THRESHOLD``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import stored

#: Fixed rules (host and path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING = 0.85
ROUNDS = 20
#: The rounds end when no host's trust or distrust changes by more than this.
TOLERANCE = 1e-4
THRESHOLD = 0.01
_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*(https?://[^\"'\s>]+|//[^\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str | Column) -> Column:
    """What stands after the first :// up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    column = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(column, _AFTER_SCHEME, 1), _UPPER, _LOWER), F.lit(""))


def path(url: str | Column) -> Column:
    """What follows the host, up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(F.col(url) if isinstance(url, str) else url, _AFTER_SCHEME, 2), F.lit(""))


def rule_of(hosts: Column, paths: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as it is written; null if none does."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((hosts == name) | hosts.endswith("." + name)) & paths.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def edges(pages: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``weight``: the share of the links of host ``a``, to other hosts, that lead to host ``b``."""
    links = pages.select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("to"))
    links = links.select("a", host(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("b"))
    counts = links.where("a <> '' AND b <> '' AND a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    totals = counts.groupBy("a").agg(F.sum("n").alias("total"))
    return counts.join(totals, "a").select("a", "b", (F.col("n") / F.col("total")).alias("weight"))


def ranks(links: DataFrame, seeds: DataFrame, column: str) -> DataFrame:
    """Personalised PageRank from ``seeds`` (host) over ``links`` (a, b, weight): ``host`` and ``column``.

    Every seed sends 1 - damping; hosts that nothing reaches have no row. Each round is one join and one sum per host,
    written to the shared folder; the driver sees the largest change. Rounds end at ``TOLERANCE`` or after ``ROUNDS``.
    """
    start = seeds.select("host", F.lit(1 - DAMPING).alias(column))
    now = stored(start)
    for _ in range(ROUNDS):
        moved = links.join(now, links["a"] == now["host"]).groupBy(F.col("b").alias("host")).agg((DAMPING * F.sum(F.col("weight") * F.col(column))).alias(column))
        grown = stored(moved.unionByName(start).groupBy("host").agg(F.sum(column).alias(column)))
        both = grown.join(now.withColumnRenamed(column, "before"), "host", "left")
        change = both.agg(F.max(F.abs(F.col(column) - F.coalesce("before", F.lit(0.0))))).first()[0]
        now = grown
        if change is None or change <= TOLERANCE:
            break
    return now


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every row.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed; null html has no links;
    repeated rows each get a row; further columns are ignored; an empty table gives an empty result.
    """
    whole = pages.select("page_id", host("url").alias("host"), path("url").alias("path"), "html")
    rows = stored(whole.drop("html").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    verdict = F.lit(None).cast("string")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    links = stored(edges(whole))
    votes = stored(rows.where("rule IS NOT NULL").groupBy("host").agg(F.sum(F.when(verdict == "allow", 1).otherwise(-1)).alias("votes")))
    trust = ranks(links, votes.where("votes > 0"), "trust")
    inward = links.groupBy("b").agg(F.sum("weight").alias("total"))
    against = stored(links.join(inward, "b").select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("weight") / F.col("total")).alias("weight")))
    distrust = ranks(against, votes.where("votes <= 0"), "distrust")
    scores = trust.unionByName(distrust, allowMissingColumns=True).groupBy("host").agg(
        F.coalesce(F.sum("trust"), F.lit(0.0)).alias("trust"), F.coalesce(F.sum("distrust"), F.lit(0.0)).alias("distrust"))
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= THRESHOLD)
    found = rows.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    return found.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                        "trust", "distrust")


def op4_linkgraph(spark: SparkSession, folder: str) -> DataFrame:
    return judged(common.table(spark, folder, "pages", "page_id", "url", "html"))


common.shipped(__name__)
