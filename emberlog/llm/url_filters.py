"""URL filters (2): host and path rules, and link-graph propagation of trust and distrust. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower
from emberlog.session import cut

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, host: str = "host", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute and scheme-relative href and src attributes."""
    urls = F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'<>]+)"), F.lit(1))
    links = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(urls).alias("url"))
    dst = host_of(F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url")))
    return links.select("src", dst.alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, at_once: int = 8) -> DataFrame:
    """Personalised PageRank of several graphs: edges (kind, src, dst, part) and seeds (kind, host, seed), which sum to 1.

    The mass of hosts without out-links returns to the seeds; that only scales the ranks, so x = seeds + damping * moved x
    is iterated without it and scaled to a sum of 1 at the end. x only grows, by at most damping**k in round k, so its
    sum tells how far it is: a kind is done when `at_once` rounds add at most `tolerance` of it (90 rounds at most for
    0.85 and 1e-6). Each round is one join and one sum with map-side combining; a table is written every `at_once`
    rounds, so lost executors never replay more than that. Hosts without rank have no row.
    """
    rank, before = seeds.select("kind", "host", F.col("seed").alias("rank")), {}
    while True:
        for _ in range(at_once):
            moved = rank.join(edges.withColumnRenamed("kind", "k"), (F.col("kind") == F.col("k")) & (F.col("host") == F.col("src"))).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("part") * damping).alias("rank"))
            rank = moved.unionByName(seeds.select("kind", "host", F.col("seed").alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = cut(rank, "rank")
        total = {r["kind"]: r["t"] for r in rank.groupBy("kind").agg(F.sum("rank").alias("t")).collect()}
        if all(t - before.get(k, 0.0) <= tolerance * t for k, t in total.items()):
            break
        before = total
    scale = F.lit(1.0)
    for k, t in total.items():
        scale = F.when(F.col("kind") == k, F.lit(1.0 / t)).otherwise(scale)
    return rank.select("kind", "host", (F.col("rank") * scale).alias("rank"))


def host_verdicts(pages: DataFrame, edges: DataFrame, ratio: float = 1.0, **options) -> DataFrame:
    """(host, trust, distrust, block) for every host that has either score.

    Seeds are the hosts with pages that the rules allow or block, by number of such pages. Trust spreads along links,
    distrust against them (who links to a blocked host is suspect). A host is blocked if its distrust is above `ratio`
    times its trust. pages: (host, verdict of its rule or null); edges: (src, dst, n).
    """
    count = cut(pages.where("host <> '' and verdict is not null").groupBy(F.col("verdict").alias("kind"), "host").agg(F.count("*").alias("n")), "seeds")
    total = count.groupBy(F.col("kind").alias("k")).agg(F.sum("n").alias("all"))  # two rows at most
    seeds = cut(count.join(F.broadcast(total), F.col("kind") == F.col("k")).select("kind", "host", (F.col("n") / F.col("all")).alias("seed")), "seed")
    ways = edges.select(F.lit("allow").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    links = cut(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("part")), "links")
    rank = page_rank(links, seeds, **options)
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return rank.groupBy("host").agg(score("allow").alias("trust"), score("block").alias("distrust")).withColumn("block", F.col("distrust") > F.col("trust") * ratio)


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, **options) -> DataFrame:
    """Judge every page: the longest fitting rule decides, else its host's propagated scores, else it is allowed.

    Null urls and urls without :// have an empty host and path, no rule, and are allowed; null html has no links.
    Repeated rows are judged each by itself. Hosts without trust or distrust are allowed. Returns
    (page_id, host, path, rule, verdict, trust, distrust), a row for each input row.
    """
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    p = p.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    small = p.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    edges = cut(host_links(p), "edges")
    hosts = host_verdicts(small, edges, **options)
    # only hosts that are blocked change a verdict; a hot host's pages are split by adaptive execution
    found = small.join(hosts.select("host", "trust", "distrust", "block"), "host", "left")
    verdict = F.coalesce("verdict", F.when(F.col("block"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
