"""Exclusion rules of portals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.binding import unused
from lavra.sources.scratch import written


def parse_rules(robots: DataFrame) -> DataFrame:
    """Rows (host, ordem, prefix, rest) of robots texts (host, texto): disallow rules of the generic agent.

    Texts are lower-cased; every agent line starts a section, which applies when it names `*` or nothing.
    Allow lines and empty rules say nothing. A rule fits from the path's beginning, `*` stands for anything:
    prefix is what stands before the first `*`, rest a pattern for what follows from there on, null where
    there is none. The rule `/` fits every path, the empty one too.
    """
    lines = robots.select("host", F.posexplode(F.split(F.lower(F.coalesce("texto", F.lit(""))), r"\r\n|[\r\n]")).alias("ordem", "line")).withColumn("line", F.trim("line"))
    value = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    agents = F.collect_list(F.when(F.col("line").startswith("user-agent:"), F.struct("ordem", value.alias("agent"))))
    rules = F.collect_list(F.when(F.col("line").startswith("disallow:") & (value != ""), F.struct("ordem", value.alias("rule"))))
    per_host = lines.groupBy("host").agg(F.array_sort(agents).alias("agents"), rules.alias("rules"))
    each = per_host.select("host", "agents", F.explode("rules").alias("r"))
    applies = F.expr("try_element_at(filter(agents, a -> a.ordem < r.ordem), -1).agent in ('*', '')")
    rule = F.when(F.col("r.rule") == "/", "").otherwise(F.col("r.rule"))
    # Everything but `*` is taken literally.
    rest = F.array_join(F.transform(F.split(F.regexp_replace(rule, r"^[^*]*", ""), r"\*"), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), ".*")
    return each.where(applies).select(
        "host", F.col("r.ordem").alias("ordem"), F.regexp_extract(rule, r"^([^*]*)", 1).alias("prefix"), F.when(F.contains(rule, F.lit("*")), F.concat(F.lit("^"), rest)).alias("rest"),
    )


def filter_robots(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """urls without those that a rule of their host forbids; hosts without rules allow everything.

    Rules (host, prefix, rest) as parse_rules gives them: a rule fits a path that begins with prefix, if what
    follows matches rest, where there is one. Of each distinct path only the beginnings that are as long as a
    rule of its host are looked up, as equal keys; so a path meets the rules that share its beginning, however
    many its host has, and a pattern is tried only behind a `*`. Columns of urls stay, whatever their names.
    """
    host, path = unused(urls, "host", "path")
    of_host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))
    of_path = F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#;]*)", 1)
    keyed = urls.withColumns({host: of_host, path: of_path})
    # As many lengths as the longest rule has characters, at most.
    lengths = written(rules.groupBy("host").agg(F.collect_set(F.char_length("prefix")).alias("lengths")), "rule-lengths")
    paths = keyed.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct().join(lengths, "host")
    begins = paths.select("host", "path", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n")).select("host", "path", F.substring("path", F.lit(1), F.col("n")).alias("prefix"), "n")
    known = written(rules.groupBy("host", "prefix").agg(F.bool_or(F.col("rest").isNull()).alias("always"), F.collect_set("rest").alias("rests")), "rules")
    fits = F.col("always") | F.exists("rests", lambda r: F.rlike(F.substring("path", F.col("n") + 1, F.char_length("path")), r))
    closed = begins.join(known, ["host", "prefix"]).where(fits).select(F.col("host").alias("h"), F.col("path").alias("p")).distinct()
    return keyed.join(closed, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left_anti").select(*urls.columns)
