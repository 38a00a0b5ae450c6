"""URL filters: rules by host and path, and link-graph propagation where no rule fits.

Trust spreads by personalised PageRank from trusted hosts along links; distrust spreads from blocked
hosts against the direction of links, to those that point at them. Rank that reaches a host without
links returns to the seeds. A host is blocked when its distrust passes a threshold and outweighs its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.sources.scratch import written

DAMPING = 0.85
#: A host is blocked from this distrust on, if it exceeds its trust. On this scale 1 is a wholly blocked host
#: without links; however many others are blocked, one keeps 0.15 at least, and passes on 0.127 or more: a
#: host that points at it is blocked unless it shares that with two others or has more trust.
THRESHOLD = 0.06
#: Rounds go on until no host's rank changes by more, on that scale.
TOLERANCE = 1e-4
#: Rounds between two writes of the ranks.
WRITE_EVERY = 5
#: Links of a host that one task passes rank along.
HUB_LINKS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def _after(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.char_length(url)))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path), one per row of pages."""
    return pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table; any DataFrame of these columns serves as well."""
    row = lambda r: F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(r, ("host", "path", "verdict"))))
    listed = F.array(*map(row, rules)).cast("array<struct<host: string, path: string, verdict: string>>")
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, rules): the rules whose host is the host or a domain above it, for each distinct host.

    Hosts are matched by equality of their suffixes, so the work grows with hosts and rules, not with
    their product.
    """
    labels = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    lists = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").groupBy(F.col("host").alias("suffix")).agg(
        F.collect_set(F.struct(F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_size"), "path", "verdict")).alias("list")
    )
    return suffixes.join(lists, "suffix").groupBy("host").agg(F.flatten(F.collect_list("list")).alias("rules"))


def best_rule(rules: Column, path: Column) -> Column:
    """The longest fitting rule: of equal lengths the one with the longer host, then a block."""
    fitting = F.filter(rules, lambda r: F.startswith(path, r["path"]))
    ranked = F.transform(fitting, lambda r: F.struct(F.char_length(r["rule"]).alias("size"), r["host_size"].alias("host_size"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))
    return F.array_max(ranked)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (source, target, weight): how many links of one host's pages lead to another host.

    Links are the absolute and the scheme-relative href values of the whole html; links within a host
    say nothing about others and are left out.
    """
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(hrefs).alias("href"))
    absolute = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    return links.select("source", host_of(absolute).alias("target")).where("source <> target and source <> '' and target <> ''").groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("weight")
    )


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Rows (kind, host, rank): personalised PageRank, the ranks of a kind summing to its seeds' weights.

    edges: (kind, source, target, share), the shares of a source summing to one; seeds: (kind, host, weight).
    Rank that reaches a host without edges returns to the seeds by weight. That fixed point is, but for
    scale, the one without any return, so rounds need no total; they go on until no rank changes by more
    than `tolerance`, which damping brings about for any graph. Each round sums by target before the
    shuffle, and a host's edges are dealt to several tasks beyond HUB_LINKS. Ranks are written every few
    rounds, which bounds what a lost executor costs.
    """
    hubs = edges.groupBy("kind", "source").agg(F.ceil(F.count(F.lit(1)) / HUB_LINKS).cast("int").alias("parts")).where("parts > 1")
    hubs = written(hubs, "hubs")
    own_parts = lambda df: F.coalesce("parts", F.lit(1))
    dealt = edges.join(hubs, ["kind", "source"], "left")
    dealt = written(dealt.withColumn("part", F.pmod(F.xxhash64("target"), own_parts(dealt)).cast("int")).drop("parts"), "dealt-edges")
    restart = seeds.select("kind", "host", F.col("weight").alias("rank"))
    ranks, settled = restart, False
    while not settled:
        for k in range(WRITE_EVERY):
            sent = ranks.withColumnRenamed("host", "source").join(hubs, ["kind", "source"], "left")
            sent = sent.select("kind", "source", "rank", F.explode(F.sequence(F.lit(0), own_parts(sent) - 1)).alias("part"))
            moved = sent.join(dealt, ["kind", "source", "part"]).select("kind", F.col("target").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            new = moved.unionByName(restart).withColumn("old", F.lit(0.0))
            if k == WRITE_EVERY - 1:
                new = new.unionByName(ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old")))
            ranks = new.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"))
            if k < WRITE_EVERY - 1:
                ranks = ranks.drop("old")
        last = written(ranks, "ranks")
        settled = last.where(F.abs(F.col("rank") - F.col("old")) > tolerance).isEmpty()
        ranks = last.drop("old")
    # Two rows, one for each kind.
    scale = ranks.groupBy("kind").agg(F.sum("rank").alias("total")).join(seeds.groupBy("kind").agg(F.sum("weight").alias("weight")), "kind")
    return ranks.join(F.broadcast(scale), "kind").select("kind", "host", (F.col("rank") * F.col("weight") / F.col("total")).alias("rank"))


def host_trust(hosts: DataFrame, edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (host, trust, distrust, verdict) for each of hosts, the distinct hosts.

    edges: (source, target, weight). seeds: (host, trust, distrust), weights from 0 to 1: how far the host
    is known to be good, and bad. Without seeds a rank is 0 everywhere. Ranks are rounded to three digits.
    """

    def shares(of: DataFrame, kind: str, source: str, target: str) -> DataFrame:
        # A table of its own, so that the planner can split a host with very many links.
        total = written(of.groupBy(F.col(source).alias("source")).agg(F.sum("weight").alias("total")), "link-totals")
        return of.select(F.col(source).alias("source"), F.col(target).alias("target"), "weight").join(total, "source").select(
            F.lit(kind).alias("kind"), "source", "target", (F.col("weight") / F.col("total")).alias("share")
        )

    both = written(shares(edges, "trust", "source", "target").unionByName(shares(edges, "distrust", "target", "source")), "edges")
    weights = [seeds.select(F.lit(kind).alias("kind"), "host", F.col(kind).alias("weight")).where("weight > 0") for kind in ("trust", "distrust")]
    ranks = propagate(both, written(weights[0].unionByName(weights[1]), "seeds"), tolerance, damping).groupBy("host").agg(
        *(F.sum(F.when(F.col("kind") == kind, F.col("rank"))).alias(kind) for kind in ("trust", "distrust"))
    )
    judged = hosts.join(ranks, "host", "left").select("host", *(F.round(F.coalesce(F.col(c), F.lit(0.0)), 3).alias(c) for c in ("trust", "distrust")))
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return judged.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: DataFrame, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one per page: by the longest fitting rule, else by its host's trust.

    Every host with pages that a rule decides is a seed: of trust by the share of these pages that are
    allowed, of distrust by the share that are blocked. Null urls have no host and path, and an empty host
    is allowed unless a rule fits it. Null ids stay. Only hosts are shuffled for the ranks, never html;
    pages get their host's rules and verdict by a join on the host that the planner broadcasts or splits
    where a host is hot.
    """
    urls = split_urls(pages)
    hosts = written(urls.select("host").distinct(), "hosts")
    listed = written(hosts.join(rules_by_host(hosts, rules), "host", "left"), "host-rules")
    ruled = urls.join(listed, "host").select("page_id", "host", "path", best_rule(F.col("rules"), F.col("path")).alias("best"))
    blocked = F.avg((F.col("best.verdict") == "block").cast("double"))
    seeds = written(ruled.where("best is not null").groupBy("host").agg(blocked.alias("distrust")).withColumn("trust", 1 - F.col("distrust")), "seed-hosts")
    trust = written(host_trust(hosts, written(host_edges(pages), "links"), seeds, tolerance, threshold=threshold), "trust")
    per_page = written(trust.select("host", F.col("verdict").alias("by_trust")).join(listed, "host"), "judged-hosts")
    return urls.join(per_page, "host").select(
        "page_id", "host", "path", best_rule(F.col("rules"), F.col("path")).alias("best"), "by_trust"
    ).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "by_trust").alias("verdict"))
