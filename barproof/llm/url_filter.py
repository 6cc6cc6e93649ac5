"""URL filters: path rules, and trust along links for what no rule covers.

Hosts are nodes; the pages' absolute links are edges between hosts.  Trust is a
personalised PageRank from hosts whose pages the rules mostly allow, along links;
distrust is one from hosts whose pages they mostly block, against links (who
links to the blocked is suspect).  A host whose distrust is over ``ratio`` times its trust and over
``least`` times the mean share is blocked.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is allowed; hosts without links or seeds have neither trust nor
distrust and are allowed; null html has no links; repeated page ids give one row
each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barproof.llm import graph

#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = r"(?s)://([^/?#]*)([^?#]*)"
    return F.coalesce(F.translate(F.regexp_extract(url, found, 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(url, found, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _most(verdict: str) -> Column:
    """1 if the rules say so of more than half of a host's pages."""
    return (2 * F.count(F.when(F.col("ruled") == verdict, 1)) > F.count(F.lit(1))).cast("int")


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, tables: graph.Tables, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """edges (kind, src, dst, w), seeds (kind, node) -> (kind, node, rank), one ranking for each kind.

    Rank starts at the seeds and goes along edges, ``damping`` of it at each step, until less than ``tolerance`` of it is
    still on its way; the sum of all that passed a node is its rank (scaled to a sum of one, which is what rank that
    leaves the graph or stops comes to if it goes back to the seeds)."""
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    steps = tables.keep(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("node"), "dst", (damping * F.col("w") / F.col("all")).alias("share")))
    many = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    now = tables.keep(seeds.join(F.broadcast(many), "kind").select("kind", "node", (F.lit(1.0) / F.col("n")).alias("rank")))  # a row for each kind
    passed = now
    while True:
        now = tables.keep(now.join(steps, ["kind", "node"]).groupBy("kind", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("rank")))
        on_way = now.groupBy("kind").agg(F.sum("rank").alias("r")).agg(F.max("r")).first()[0]
        if on_way is None:
            break
        passed = passed.unionByName(now)
        if on_way < tolerance:
            break
    rank = passed.groupBy("kind", "node").agg(F.sum("rank").alias("rank"))
    return rank.join(F.broadcast(passed.groupBy("kind").agg(F.sum("rank").alias("total"))), "kind").select("kind", "node", (F.col("rank") / F.col("total")).alias("rank"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rules=RULES, ratio: float = 1.0, least: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page."""
    host, path = host_and_path(pages[url_col].cast("string"))
    own = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), *([pages[html_col].cast("string").alias("html")] if html_col else []))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = own.drop("html").withColumns({"rule": rule, "ruled": verdict})
    with graph.Tables(pages) as tables:
        hosts = tables.keep(judged.where("host <> ''").groupBy("host").agg(_most("allow").alias("good"), _most("block").alias("bad")))
        links = own.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")) if html_col else hosts.where("false").select(F.col("host").alias("src"), F.col("host").alias("dst"))
        forth = tables.keep(links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
        edges = forth.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(forth.select(F.lit("distrust"), F.col("dst"), F.col("src"), "w"))
        seeds = hosts.where("good = 1").select(F.lit("trust").alias("kind"), F.col("host").alias("node")).union(hosts.where("bad = 1").select(F.lit("distrust"), "host"))
        rank = personalised_pagerank(edges, seeds, tables)
        pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rank"))).alias(kind)
        scores = tables.result(rank.groupBy(F.col("node").alias("host")).agg(pick("trust"), pick("distrust")))
        mean = 1.0 / max(hosts.count(), 1)
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    found = F.when((d > ratio * t) & (d > least * mean), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", found).alias("verdict"), F.round(t, 12).alias("trust"), F.round(d, 12).alias("distrust"))
