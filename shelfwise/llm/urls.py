"""URL filters: rules, and trust that flows over the link graph.

Hosts are judged by two personalised PageRanks over host-to-host links: trust starts at hosts with pages that a rule
allows and follows links; distrust starts at hosts with pages that a rule blocks and follows links backwards, to those
who link there. A host is bad, and its pages without a rule are blocked, if its distrust is above its trust and at least
`DISTRUST` times what it would start with if distrust were dealt evenly over all pages. A seed's own rank counts.

Links are summed to host pairs before anything else, so no step holds a host's pages. Ranks are kept a row a host, sums
are made with partial sums, and the ranks are written to shared storage every `CUT` rounds to end their lineage. Hosts with
a hundredth of all links or more, at most a hundred of each kind, have their ranks broadcast to their links, which stay
where they are. Rounds are fixed; what is left undone after k of them is at most DAMPING**k of the whole.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; of rules of one
length the first listed wins; null or empty html has no links; repeated pages weigh as often as they occur; with no seeds of
a kind that rank is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_hot, materialise, tidy

#: Rules as (kind, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ROUNDS = 16
CUT = 4
#: A bad host's distrust is at least so many times what its share of all pages would start with.
DISTRUST = 1.0
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule (the first of equally long ones) whose host is the host or above it and whose path the path begins with."""
    out = F.lit(None).cast("string")
    for _, (_, rule) in sorted(enumerate(rules), key=lambda r: (len(r[1][1]), -r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for kind, name in rules:
        out = F.when(rule == name, F.lit(kind)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """source, target and count of links between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1))).alias("target"))
    return links.select("source", ascii_lower(F.col("target")).alias("target")).filter("source != '' AND source != target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def ranks(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust. seeds: kind ('allow' or 'block'), host, weight."""
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("start"))
    forward = links.select(F.lit("allow").alias("kind"), F.col("source").alias("host"), F.col("target").alias("next"), "n")
    backward = links.select(F.lit("block").alias("kind"), F.col("target").alias("host"), F.col("source").alias("next"), "n")
    both = materialise(forward.unionByName(backward), "url-links")
    degree = materialise(both.groupBy("kind", "host").agg(F.sum("n").alias("out"), F.count(F.lit(1)).alias("rows")), "url-degrees")
    most = degree.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] / 200  # a hundredth of the links of a kind
    hot = materialise(degree.filter(F.col("rows") >= most).select("kind", "host", "out"), "url-hubs")
    key = ["kind", "host"]
    share = (F.col("n") / F.col("out")).alias("share")
    marked = both.join(F.broadcast(hot), key, "left")
    cold = marked.filter("out IS NULL").drop("out").join(degree.filter(F.col("rows") < most), key)
    edges = marked.filter("out IS NOT NULL").select(*key, "next", share, F.lit(True).alias("hot")).unionByName(cold.select(*key, "next", share, F.lit(False).alias("hot")))
    edges = materialise(edges, "url-edges")
    start = materialise(start, "url-seeds")
    now = start.select("kind", "host", F.col("start").alias("rank"))
    hubs = not hot.isEmpty()
    part = (damping * F.col("rank") * F.col("share")).alias("part")
    if not edges.isEmpty():
        for k in range(1, rounds + 1):
            flow = edges.filter("NOT hot").join(now, key).select("kind", F.col("next").alias("host"), part)
            if hubs:
                of_hubs = now.join(F.broadcast(hot.select(*key)), key, "left_semi")
                flow = flow.unionByName(edges.filter("hot").join(F.broadcast(of_hubs), key).select("kind", F.col("next").alias("host"), part))
            back = start.select("kind", "host", ((1 - damping) * F.col("start")).alias("part"))
            now = flow.unionByName(back).groupBy("kind", "host").agg(F.sum("part").alias("rank"))
            if hubs or k % CUT == 0:  # with hubs, the ranks are read twice
                now = materialise(now, "url-ranks")
    else:
        now = now.withColumn("rank", (1 - damping) * F.col("rank"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return now.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))


@tidy
def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, distrust: float = DISTRUST) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    known = materialise(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "url-pages")
    hosts = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(verdict_of(F.col("rule"), rules) == k, 1)).alias(k) for k in ("allow", "block")))
    hosts = materialise(hosts, "url-hosts")
    seeds = hosts.select(F.lit("allow").alias("kind"), "host", F.col("allow").alias("weight")).unionByName(hosts.select(F.lit("block").alias("kind"), "host", F.col("block").alias("weight"))).filter("weight > 0")
    rank = ranks(host_links(pages), seeds)
    every = float(hosts.agg(F.sum("n")).first()[0] or 1)
    none = F.lit(0.0)
    scored = hosts.join(rank, "host", "left").select("host", F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"), F.col("n").alias("host_pages"))
    even = (1 - DAMPING) * F.col("host_pages") / F.lit(every)
    bad = (F.col("host") != "") & (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= distrust * even)
    judged = join_hot(known, scored.withColumn("bad", bad), "host", "host_pages")
    method = F.when(F.coalesce(F.col("bad"), F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), method).alias("verdict"), F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
