"""URL filters: host and path rules, and trust and distrust spread over the links between hosts.

A rule is ``host/path`` with a verdict. It fits a host and its subdomains where the url's path starts with the rule's
path (so ``net/``, whose path is ``/``, does not fit a url with an empty path); the longest rule wins, block before
allow, then the smaller text.

Pages that no rule fits get their host's verdict from the link graph: hosts that allow rules name are trusted seeds and
hosts that block rules name are blocked seeds, weighted by the share of the host's pages that the rule decides.
Personalised PageRank runs along links from trusted seeds, and against them from blocked seeds (who links to a blocked
host is suspect). What a host receives over links, without its own seed, decides: it is blocked where its distrust, as
a multiple of the mean host's share, exceeds ``threshold`` and its trust. A host without links to or from others
receives nothing and is allowed.

Hosts that are only linked to are judged by the rules at the path ``/`` and are seeds like the others. Links name hosts without port
and user part; a page's host takes part in the graph under the same short name. Passes go on until what a pass still moves is below
``settled`` of the seeds' mass, at most ``rounds`` of them.

All of it is joins and sums over (host, host) pairs; each fourth pass over the graph is written to the checkpoint folder.
Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has
no links; repeated rows each get a result; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: Hosts whose verdicts may be sent to every executor (some 64 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 500_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The struct (rule, verdict) of the rule that decides, else null; rules: pairs, a short list that the caller wrote."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(ordered):
        where, slash, rest = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(host: Column) -> Column:
    """A host's name in the graph: without user part and port."""
    return F.regexp_replace(host, r"^[^@]*@|:\d+$", "")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst, pages that link) between different hosts; pages has host and html."""
    links = pages.where(F.col("html").contains("//")).select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select(node_of(F.col("host")).alias("src"), ascii_lower(node_of(F.col("dst"))).alias("dst"))
    return links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 400, damping: float = 0.85, settled: float = 1e-6) -> DataFrame:
    """(kind, host, received): what each host receives over edges (kind, src, dst, share) from seeds (kind, host, seed).

    The mass that seeds send is followed link by link: a pass moves ``damping`` of what came last, and received sums the passes. That is
    the personalised PageRank, without the share that a seed keeps; what a pass still moves bounds what is missing.
    """
    moving = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    total = None
    for i in range(rounds):
        sent = moving.alias("r").join(edges.alias("e"), F.expr("r.kind = e.kind and r.host = e.src"))
        moving = sent.groupBy(F.col("e.kind").alias("kind"), F.col("e.dst").alias("host")).agg(F.sum(F.col("r.rank") * F.col("e.share") * damping).alias("rank"))
        total = moving if total is None else total.unionAll(moving).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3:
            moving, total = materialise(moving), materialise(total)
            if (moving.agg(F.sum("rank")).first()[0] or 0.0) <= settled:
                break
    else:
        raise RuntimeError(f"trust and distrust did not settle in {rounds} passes")
    return total.withColumnRenamed("rank", "received")


def blocked_hosts(pages: DataFrame, rules, rounds: int = 400, threshold: float = 0.5) -> DataFrame | None:
    """Hosts that the link graph blocks; None where no host links to another. pages: host, path, html."""
    edges = materialise(host_edges(pages))
    if edges.isEmpty():
        return None
    turned = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = turned.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = materialise(turned.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct().join(pages.select(node_of(F.col("host")).alias("host")).distinct(), "host", "left_anti")
    rows = pages.select("host", "path").unionAll(linked.select("host", F.lit("/").alias("path")))
    judged = rows.select(node_of(F.col("host")).alias("host"), fitting_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("v")).groupBy("host")
    share = judged.agg(F.avg(F.when(F.col("v") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("v") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    seeds = share.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "seed")).where("seed > 0")
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("all_seeds"))
    seeds = materialise(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("seed") / F.col("all_seeds")).alias("seed")))
    got = propagate(shares, seeds, rounds)
    hosts = edges.select("src").union(edges.select("dst")).distinct().count()
    one = got.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("received")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("received")).otherwise(0.0)).alias("distrust"),
    )
    return materialise(one.where((F.col("distrust") * hosts > threshold) & (F.col("distrust") > F.col("trust"))).select("host"))


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html", rounds: int = 400, threshold: float = 0.5) -> DataFrame:
    """pages with __host, __path, __rule and __verdict."""
    wide = pages.withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))})
    bad = blocked_hosts(wide.select(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col(html_col).alias("html")), rules, rounds, threshold)
    wide = wide.withColumn("__fit", fitting_rule(F.col("__host"), F.col("__path"), rules))
    if bad is None:
        wide = wide.withColumn("__bad", F.lit(None).cast("string"))
    else:
        small = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
        bad = bad.select(F.col("host").alias("__bad"))
        wide = wide.join(F.broadcast(bad) if small else bad, node_of(F.col("__host")) == F.col("__bad"), "left")
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("__bad").isNotNull(), "block").otherwise("allow"))
    return wide.withColumns({"__rule": F.col("__fit.rule"), "__verdict": verdict}).drop("__fit", "__bad")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))
