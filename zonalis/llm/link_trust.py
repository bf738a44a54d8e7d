"""URL filter rules, and link-graph propagation for the hosts that no rule decides.

Hosts are nodes; an absolute link of a page is an edge from its host, and every host
has an edge to itself, which its relative links stand for. Trust is personalised
PageRank along the edges from hosts with allowed pages (seed: the share of a host's pages that are); distrust is the same along
reversed edges from hosts with blocked pages. A host whose distrust exceeds ``ratio``
times its trust is blocked, any other allowed. Edges are counted before they are
shuffled, ranks never leave the executors.

Defined results: a null url, or one without ``://``, has an empty host and path, meets no
rule and is allowed; null html has no links; repeated rows are judged each; no rules fit
an empty table, which gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

MAX_RULES = 1000
DAMPING, ROUNDS, RATIO, DIGITS = 0.85, 10, 1.0, 9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(verdict, host, path)`` that fits, and its verdict; else null. Of
    equally long rules the blocking one wins, then the first by name."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an expression holds {MAX_RULES} at most")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", [-ord(x) for x in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``."""
    host, path = split_url(F.col(url))
    src = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))), lambda x: F.translate(x, _UPPER, _LOWER)).alias("links"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    src = core.stage(src.withColumns({"rule": rule, "verdict": verdict}), "pages")
    scored = scores(src)
    out = src.drop("links").join(scored, "host", "left")
    bad = F.round(F.coalesce("distrust", F.lit(0.0)), DIGITS) > F.round(RATIO * F.coalesce("trust", F.lit(0.0)), DIGITS)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")


def scores(pages: DataFrame) -> DataFrame:
    """``host, trust, distrust`` from ``host, links, verdict``."""
    named = pages.where("host <> ''")
    hosts = core.stage(named.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")), "hosts")
    links = named.select("host", F.explode("links").alias("to")).where("host <> to").groupBy("host", "to").agg(F.count("*").alias("w"))
    loops = hosts.select("host", F.col("host").alias("to"), F.lit(1).cast("long").alias("w"))
    targets = links.select(F.col("to").alias("host"), "to", F.lit(1).cast("long").alias("w")).distinct().join(hosts.select("host"), "host", "left_anti")
    edges = links.unionByName(loops).unionByName(targets)
    both = edges.select(F.lit("trust").alias("kind"), "host", "to", "w").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("to").alias("host"), F.col("host").alias("to"), "w"))
    degree = both.groupBy("kind", "host").agg(F.sum("w").alias("all"))
    walk = core.stage(both.join(degree, ["kind", "host"]).select("kind", "host", "to", (F.col("w") / F.col("all")).alias("p")), "walk")
    seeded = lambda kind, n: hosts.where(F.col(n) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(n) / F.col("n")).alias("s"))
    seed = core.stage(seeded("trust", "good").unionByName(seeded("distrust", "bad")), "seed")
    rank = seed.select("kind", "host", F.col("s").alias("r"))
    for i in range(ROUNDS):
        moved = walk.join(rank, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg((F.sum(F.col("r") * F.col("p")) * DAMPING).alias("r"))
        rank = moved.join(seed, ["kind", "host"], "full").select("kind", "host", (F.coalesce("r", F.lit(0.0)) + (1 - DAMPING) * F.coalesce("s", F.lit(0.0))).alias("r"))
        if i % 5 == 4:
            rank = core.stage(rank, "rank")
    return rank.groupBy("host").agg(F.max(F.when(F.col("kind") == "trust", F.col("r"))).alias("trust"), F.max(F.when(F.col("kind") == "distrust", F.col("r"))).alias("distrust"))
