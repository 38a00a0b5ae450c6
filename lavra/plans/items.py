"""Feeds, listings, rules of portals and merged items, from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.urls import normalize_url
from lavra.operators import items, robots, rows
from lavra.sources.keyed import KeyedStore
from lavra.sources.scratch import shared_folder
from lavra.sources.tables import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), "html")


def _feeds(spark: SparkSession, sf: str) -> DataFrame:
    """A feed for each page, of its title and address; every fourth is no feed."""
    title = F.regexp_replace(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), r"&(?!\w+;)", "&amp;")
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    day = F.concat(F.lit("Mon, "), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" Aug 2024 10:00:00 -0300"))
    feed = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><item><title>'), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), day, F.lit("</pubDate><description>&lt;p&gt;Body&lt;/p&gt;</description></item></channel></rss>"))
    return _pages(spark, sf).select(F.col("page_id").cast("string").alias("portal"), F.lit("Inst").alias("instituicao"), F.col("url").alias("base"), F.when(F.col("page_id") % 4 > 0, feed).otherwise("<html>no feed").alias("conteudo"))


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select(F.col("page_id").cast("string").alias("portal"), F.lit("Inst").alias("instituicao"), F.col("url").alias("base"), F.col("html").alias("conteudo"))


def from_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return items.parse_feeds(_feeds(spark, sf)).select("portal", "ordem", "data", "url", "texto")


def from_listings(spark: SparkSession, sf: str) -> DataFrame:
    return items.parse_listings(_listings(spark, sf))


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return items.extract_items(_feeds(spark, sf), _listings(spark, sf))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """A robots text for each host, as its name says."""
    text = F.concat(F.lit("User-agent: bot\nDisallow: /\nUser-Agent: *\nDisallow: /fr/\nDisallow:\nAllow: /fr/1\nDisallow: /*.html\r\n"), F.when(F.col("host").startswith("blog."), F.lit("disallow: /")).otherwise(""))
    return robots.parse_rules(_pages(spark, sf).select("host").distinct().select("host", text.alias("texto")))


def allowed(spark: SparkSession, sf: str) -> DataFrame:
    return robots.filter_robots(_pages(spark, sf), _rules(spark, sf)).select("page_id", "url")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pages keyed by host: the ids below the middle are stored, the others come in."""
    p = _pages(spark, sf).select("page_id", F.col("host").alias("key"), F.col("host").alias("portal"))
    return p.where("page_id % 3 = 0"), p.where("page_id % 3 > 0")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return rows.merge_items(*_sides(spark, sf), "key", "page_id")


def merged_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """What a keyed store holds after the pages that come in are merged into the stored ones."""
    stored, found = _sides(spark, sf)
    store = KeyedStore(spark, shared_folder(spark, "item-store"), stored.schema, "key")
    store.append(rows.merge_items(stored, stored.limit(0), "key", "page_id").drop("estado"))
    store.merge(found, "page_id")
    return store.read()


def report(spark: SparkSession, sf: str) -> DataFrame:
    """Each host is a portal, with its pages as items; of the portals without any some are closed and some failed."""
    stored, found = _sides(spark, sf)
    hosts = _pages(spark, sf).select("host").distinct()
    open_portals = hosts.select(F.col("host").alias("portal"), F.lit(True).alias("robots_ok"), F.lit(None).cast("string").alias("erro"))
    none = hosts.select(F.concat(F.lit("empty."), F.col("host")).alias("portal"), (F.char_length("host") % 3 > 0).alias("robots_ok"), F.when(F.char_length("host") % 3 == 1, "timeout").alias("erro"))
    return items.ingest_report(open_portals.unionByName(none), found.withColumn("origem", F.lit("feed")), stored)


def by_url(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each canonical address without its query."""
    keyed = _pages(spark, sf).select("page_id", normalize_url(F.regexp_replace("url", r"[?#].*$", "")).alias("address"))
    return rows.dedup_first(keyed, ["address"], ["page_id"])


_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#;]*)', 1)"
_DECODED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_FEED = f"""f as (select page_id, page_id::varchar portal, 'Inst' instituicao, 0::int ordem, trim({_DECODED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) titulo, '2024-08-' || lpad((page_id % 28 + 1)::varchar, 2, '0') as data,
  'https://' || lower({_HOST}) || rtrim(regexp_replace({_PATH}, ';[^/]*$', ''), '/') || case when regexp_extract(url, '[?]([^#]*)', 1) <> '' then '?' || regexp_extract(url, '[?]([^#]*)', 1) else '' end
    || case when regexp_extract(url, '#(.*)$', 1) <> '' then '#' || regexp_extract(url, '#(.*)$', 1) else '' end url, 'Body' texto, 'feed' origem from pages where page_id % 4 > 0)"""
#: The pages' navigation; none of their containers has a link in a heading or paragraph.
_LISTING = f"""a as (select page_id, {_HOST} host, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) titles from pages),
b as (select page_id, host, unnest(hrefs) href, unnest(titles) title, unnest(range(len(hrefs))) place from a),
c as (select page_id, host, {_DECODED.format("href")} href, {_DECODED.format("trim(title)")} title, min(place) place from b group by all),
l as (select page_id, page_id::varchar portal, 'Inst' instituicao, (row_number() over (partition by page_id order by place) - 1)::int ordem, title titulo, null::varchar as data, 'https://' || lower(host) || rtrim(regexp_replace(href, ';[^/]*$', ''), '/') url, '' texto, 'listagem' origem
  from c where title <> '')"""
_MERGED = f"""
p as (select page_id, {_HOST} host from pages),
o as (select host, max(page_id) page_id from p where page_id % 3 = 0 group by host),
n as (select host, min(page_id) page_id from p where page_id % 3 > 0 and host not in (select host from o) group by host),
m as (select page_id, host as key, host portal, 'existente' estado from o union all select page_id, host, host, 'novo' from n)
"""

QUERIES = {
    "t1_parse_feed": from_feeds, "t2_parse_listing": from_listings, "t3_extract_items": extracted, "p7_j8_filter_robots": allowed,
    "j6_merge_items": merged, "j6_keyed_store": merged_keyed, "a9_ingest_report": report, "w1_first_page_by_url": by_url,
}
ORACLE_SQL = {
    "t1_parse_feed": f"with {_FEED} select portal, ordem, data, url, texto from f",
    "t2_parse_listing": f"with {_LISTING} select * exclude (page_id) from l",
    "t3_extract_items": f"with {_FEED}, {_LISTING} select * exclude (page_id) from f union all select * exclude (page_id) from l where page_id % 4 = 0",
    "p7_j8_filter_robots": f"""select page_id, url from pages where not starts_with({_PATH}, '/fr/') and not contains({_PATH}, '.html') and not starts_with({_HOST}, 'blog.')""",
    "j6_merge_items": f"with {_MERGED} select * from m",
    "j6_keyed_store": f"with {_MERGED} select page_id, key, portal from m",
    "a9_ingest_report": f"""with {_MERGED}, h as (select distinct host from p),
i as (select host, count(*) itens, max((host not in (select host from o))::int) novos from p where page_id % 3 > 0 group by host)
select host portal, case when itens > 0 then 'feed' end fonte, coalesce(itens, 0) itens, coalesce(novos, 0) novos, coalesce(itens, 0) - coalesce(novos, 0) ja_existentes,
  case when itens is null then 'sem itens' end aviso, null erro from h left join i using (host)
union all select 'empty.' || host, null, 0, 0, 0, case when length(host) % 3 = 0 then 'robots.txt' when length(host) % 3 = 2 then 'sem itens' end, case when length(host) % 3 = 1 then 'timeout' end from h""",
    "w1_first_page_by_url": """select min(page_id) page_id, address from (
  select page_id, 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') address from pages) group by address""",
}
