"""News items from fetched feeds and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.binding import let
from lavra.functions.dates import parse_pubdate
from lavra.functions.markup import html_nodes, inside, joined, trimmed, usable, xml_nodes
from lavra.functions.urls import resolve_url, same_page
from lavra.sources.scratch import written

#: Containers of listings in the order in which they are tried. Fixed values.
CONTAINERS = (
    ("div", "tileItem"), ("div", "newsItem"), ("div", "news-item"), ("div", "entry"), ("div", "results-item"), ("article", ""), ("li", "newsItem"), ("li", "item"), ("div", "item"),
)
#: Where a listing's date is looked for. Fixed values.
DATES = (("time", ""), ("span", "date"), ("span", "pubDate"), ("span", "newsDate"), ("span", "entry-date"), ("", "effective"), ("", "modified"))
DAY = r"^\d{1,2}/\d{1,2}/\d{4}"
ENOUGH = 2


def _nonblank(text: Column) -> Column:
    return F.when(text != "", text)


def _feed_items(nodes: Column) -> Column:
    """array<struct<titulo, href, datas, texto>>: the items of RSS 2.0 and 1.0, then the entries of Atom; texto is markup."""

    def item(box: Column, inner: Column) -> Column:
        children = lambda *tags: F.filter(inner, lambda n: (n["parent"] == box["place"]) & n["tag"].isin(*tags))
        whole = lambda n: trimmed(joined(inside(nodes, n), ""))
        first = lambda tag: F.coalesce(F.get(F.transform(F.slice(children(tag), 1, 1), whole), F.lit(0)), F.lit(""))
        any_of = lambda *tags: F.filter(F.transform(children(*tags), whole), lambda t: t != "")
        rss = F.struct(
            first("title").alias("titulo"), F.coalesce(_nonblank(first("link")), _nonblank(first("guid")), box["href"]).alias("href"), F.slice(any_of("pubDate", "date"), 1, 1).alias("datas"),
            F.coalesce(F.get(any_of("description", "texto", "summary", "content", "encoded"), F.lit(0)), F.lit("")).alias("texto"),
        )
        atom = F.struct(
            first("title").alias("titulo"), F.coalesce(F.get(children("link"), F.lit(0))["href"], F.lit("")).alias("href"),
            F.slice(F.filter(F.array(first("updated"), first("published")), lambda t: t != ""), 1, 1).alias("datas"), F.coalesce(_nonblank(first("summary")), first("content")).alias("texto"),
        )
        return F.when(box["tag"] == "item", rss).otherwise(atom)

    rss = F.lower(F.get(nodes, F.lit(0))["tag"]).isin("rss", "rdf")
    boxes = F.concat(F.filter(nodes, lambda n: rss & (n["tag"] == "item")), F.filter(nodes, lambda n: n["tag"] == "entry"))
    return F.transform(boxes, lambda box: let(inside(nodes, box), lambda inner: item(box, inner)))


def _is(node: Column, tag: str, name: str) -> Column:
    return ((node["tag"] == tag) if tag else F.lit(True)) & (F.array_contains(node["names"], name) if name else F.lit(True))


def _listing_items(nodes: Column) -> Column:
    """array<struct<kind, titulo, href, datas, texto>>: what stands in the containers, kind by kind, those without title and link left out."""
    whole = lambda n: joined(inside(nodes, n))
    dated = lambda n: F.coalesce(_nonblank(n["datetime"]), whole(n))

    def item(kind: Column, box: Column, inner: Column) -> Column:
        # The first link in a heading or paragraph, the box among them, or one that is called a title.
        link = F.get(F.filter(inner, lambda n: (n["tag"] == "a") & (F.array_contains(n["names"], "title") | (n["heading"] >= box["place"]))), F.lit(0))
        firsts = F.array(*(F.get(F.filter(inner, lambda n: _is(n, tag, name) & (n["tag"] != "")), F.lit(0)) for tag, name in DATES))
        by_selector = F.transform(F.filter(firsts, lambda n: n.isNotNull()), dated)
        days = F.filter(F.transform(F.filter(inner, lambda n: n["tag"] == "p"), whole), lambda t: t.rlike(DAY))
        block = F.get(F.filter(inner, lambda n: (n["tag"] == "p") | _is(n, "div", "description") | _is(n, "div", "text") | _is(n, "span", "description")), F.lit(0))
        return F.struct(
            kind.alias("kind"), F.when(link.isNotNull(), whole(link)).otherwise("").alias("titulo"), F.coalesce(link["href"], F.lit("")).alias("href"),
            F.concat(F.filter(by_selector, lambda d: d != ""), days).alias("datas"), F.when(block.isNotNull(), whole(block)).otherwise("").alias("texto"),
        )

    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(tag).alias("tag"), F.lit(name).alias("name")) for k, (tag, name) in enumerate(CONTAINERS)))

    def of(kind: Column) -> Column:
        boxes = F.filter(nodes, lambda n: (n["tag"] == kind["tag"]) & ((kind["name"] == "") | F.array_contains(n["names"], kind["name"])))
        return F.transform(boxes, lambda box: let(inside(nodes, box), lambda inner: item(kind["kind"], box, inner)))

    return F.filter(F.flatten(F.transform(kinds, of)), lambda i: (i["titulo"] != "") | (i["href"] != ""))


def _plain_links(nodes: Column) -> Column:
    """array of the same structs: the links of a page, with the dates that stand beside them."""
    whole = lambda n: joined(inside(nodes, n))
    dated = F.transform(F.filter(nodes, lambda n: n["tag"].isin("span", "time", "em")), lambda n: F.struct(n["place"].alias("place"), F.coalesce(_nonblank(n["datetime"]), whole(n)).alias("day")))

    def item(link: Column, days: Column) -> Column:
        end = F.when(link["parent"] < 0, F.size(nodes)).otherwise(F.get(nodes, F.greatest(link["parent"], F.lit(0)))["last"])
        beside = F.filter(days, lambda d: (d["place"] > link["parent"]) & (d["place"] <= end) & (d["day"] != ""))
        return F.struct(F.lit(len(CONTAINERS)).alias("kind"), whole(link).alias("titulo"), link["href"].alias("href"), F.transform(beside, lambda d: d["day"]).alias("datas"), F.lit("").alias("texto"))

    links = F.filter(nodes, lambda n: (n["tag"] == "a") & usable(n["href"]))
    return F.filter(let(dated, lambda days: F.transform(links, lambda n: item(n, days))), lambda i: i["titulo"] != "")


def _once(items: Column, base: Column) -> Column:
    """items, each with the same title and page only where it first stands."""

    def of(found: Column) -> Column:
        keys = F.transform(found, lambda i: F.struct(same_page(base, i["href"]), i["titulo"]))
        return let(keys, lambda ks: F.filter(found, lambda i, at: F.array_position(ks, F.get(ks, at)) == at + 1))

    return let(items, of)


def _listed(nodes: Column, base: Column) -> Column:
    """The items of a listing page: of the kinds of containers up to that by which there are ENOUGH; its plain links where there are none."""
    enough = lambda found: F.filter(found, lambda i: F.size(F.filter(found, lambda o: o["kind"] < i["kind"])) < ENOUGH)
    few = lambda found: F.when(F.size(found) > 0, enough(found)).otherwise(_once(_plain_links(nodes), base))
    return let(_once(_listing_items(nodes), base), few)


def _items(contents: DataFrame, of: Column, kind: str) -> DataFrame:
    """A row for each of the items that `of` finds in conteudo, in order; their texto is markup where it holds any."""
    based = contents.select("portal", "instituicao", F.coalesce("base", F.lit("")).alias("base"), "conteudo")
    # Outer, as otherwise the planner filters pages by their items before, and cuts each page into nodes a second time for that.
    found = based.select("portal", "instituicao", "base", F.posexplode_outer(of).alias("ordem", "i")).where("ordem is not null")
    each = found.select("portal", "instituicao", "base", "ordem", "i.*")
    marked = F.contains("texto", F.lit("<")) | F.contains("texto", F.lit("&"))
    read = each.withColumn("corpo", html_nodes(F.when(marked, F.col("texto"))))
    in_body = F.get(F.filter("corpo", lambda n: (n["tag"] == "a") & usable(n["href"])), F.lit(0))["href"]
    href = F.coalesce(_nonblank(F.col("href")), in_body, F.lit(""))
    dates = F.filter(F.transform("datas", lambda d: parse_pubdate(d)), lambda d: d.isNotNull())
    return read.select(
        "portal", "instituicao", "ordem", "titulo", F.get(dates, F.lit(0)).alias("data"), resolve_url(F.col("base"), href).alias("url"),
        F.when(F.col("corpo").isNotNull(), joined(F.col("corpo"))).otherwise(trimmed(F.col("texto"))).alias("texto"), F.lit(kind).alias("origem"),
    )


def parse_feeds(contents: DataFrame) -> DataFrame:
    """Items of feeds (portal, instituicao, base, conteudo), in the feed's order. Null and malformed contents have none."""
    return _items(contents, let(xml_nodes(F.col("conteudo")), _feed_items), "feed")


def parse_listings(contents: DataFrame) -> DataFrame:
    """Items of listing pages, of the same columns."""
    return _items(contents, let(html_nodes(F.col("conteudo")), lambda nodes: _listed(nodes, F.col("base"))), "listagem")


def extract_items(feeds: DataFrame, listings: DataFrame) -> DataFrame:
    """Each portal's feed items, or where it has none its listing's. Feeds are parsed once and written."""
    from_feeds = written(parse_feeds(feeds), "feed-items")
    without = listings.join(from_feeds.select("portal").distinct(), "portal", "left_anti")
    return from_feeds.unionByName(parse_listings(without))


def ingest_report(portals: DataFrame, found: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Rows (portal, fonte, itens, novos, ja_existentes, aviso, erro), one per portal of portals (portal, robots_ok, erro).

    found: (portal, key, origem), the items of this run, repeats included; stored: (key). An item is new
    where its key isn't stored and, of several found with a key, for the smallest portal that has it; the
    others are already there. fonte is where the portal's items came from. A portal that its rules close
    has the warning `robots.txt`, one without items and without an error another. Null robots_ok is open;
    null keys are one key.
    """
    known = stored.select(F.col(key).alias("s_key")).distinct().withColumn("known", F.lit(True))
    each = found.groupBy("portal", key).agg(F.count(F.lit(1)).alias("times"), F.min("origem").alias("origem"))
    first = each.groupBy(key).agg(F.min("portal").alias("first")).withColumnRenamed(key, "f_key")
    judged = each.join(known, F.col(key).eqNullSafe(F.col("s_key")), "left").join(first, F.col(key).eqNullSafe(F.col("f_key")))
    new = (F.col("known").isNull() & (F.col("portal") == F.col("first"))).cast("long")
    counted = judged.groupBy("portal").agg(F.min("origem").alias("fonte"), F.sum("times").alias("itens"), F.sum(new).alias("novos"))
    listed = portals.groupBy("portal").agg(F.min(F.coalesce("robots_ok", F.lit(True))).alias("open"), F.min("erro").alias("erro"))
    joined = listed.join(counted, "portal", "left").na.fill(0, ["itens", "novos"])
    warning = F.when(~F.col("open"), "robots.txt").when((F.col("itens") == 0) & F.col("erro").isNull(), "sem itens")
    return joined.select("portal", "fonte", "itens", "novos", (F.col("itens") - F.col("novos")).alias("ja_existentes"), warning.alias("aviso"), "erro")
