"""Feeds and listings against a plain reading of the same markup."""

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

from lavra.functions.text import text_nodes
from lavra.functions.markup import HEADINGS
from lavra.operators import items
from lavra.operators.items import CONTAINERS, DATES, ENOUGH

DAY = re.compile(r"\d{1,2}/\d{1,2}/\d{4}")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _whole_text(element) -> str:
    return "".join(element.itertext()).strip()


def _child(element, *names: str):
    return next((c for c in element if _local(c.tag) in names), None)


class _Hrefs(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = (dict(attrs).get("href") or "").strip()
        if tag == "a" and usable(href):
            self.found.append(href)


def _first_href(body: str) -> str:
    links = _Hrefs()
    links.feed(body)
    return next(iter(links.found), "")


def usable(href: str) -> bool:
    return bool(href) and not href.startswith("#") and not href.lower().startswith("javascript:")


def feed_entries(xml: str, base: str = "") -> list[tuple[str, str, list[str], str]]:
    """(title, href, dates, body) of the items of RSS 2.0, RSS 1.0 and Atom; none where the XML is malformed."""
    try:
        root = ElementTree.fromstring(xml.strip().encode())
    except (ElementTree.ParseError, ValueError):
        return []
    out = []
    text = lambda e: _whole_text(e) if e is not None else ""
    if _local(root.tag).lower() in ("rss", "rdf"):
        for item in (e for e in root.iter() if _local(e.tag) == "item"):
            bodies = (c for c in item if _local(c.tag) in ("description", "texto", "summary", "content", "encoded"))
            body = next((t for c in bodies if (t := _whole_text(c))), "")
            about = next((v for k, v in item.attrib.items() if _local(k) == "about"), "")
            href = text(_child(item, "link")) or text(_child(item, "guid")) or about.strip()
            href = href or _first_href(body)
            dates = [t for c in item if _local(c.tag) in ("pubDate", "date") and (t := _whole_text(c))][:1]
            out.append((text(_child(item, "title")), href, dates, body))
    for entry in (e for e in root.iter() if _local(e.tag) == "entry"):
        link = _child(entry, "link")
        dates = [t for n in ("updated", "published") if (t := text(_child(entry, n)))][:1]
        body = text(_child(entry, "summary")) or text(_child(entry, "content"))
        href = (link.get("href") or "").strip() if link is not None else ""
        out.append((text(_child(entry, "title")), href or _first_href(body), dates, body))
    return out


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator["Node"]:
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n.strip())
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return " ".join(p for p in parts if p)

    def has(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


class Tree(HTMLParser):
    """A lenient tree: an end tag closes the nearest open element of its name."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _title_link(box: Node) -> Node | None:
    """The first link in a heading or paragraph, or one that is called a title, in document order."""

    def under_heading(n: Node) -> bool:
        while (n := n.parent) is not None and n is not box.parent:
            if n.tag in HEADINGS:
                return True
        return False

    return next((n for n in box.walk() if n.tag == "a" and (n.has("title") or under_heading(n))), None)


def _dates(box: Node) -> list[str]:
    """Candidate dates: of the first element of each kind, in the order of DATES; then paragraphs that begin with d/m/yyyy."""
    nodes, found = list(box.walk()), []
    for tag, name in DATES:
        first = next((n for n in nodes if tag in ("", n.tag) and (not name or n.has(name))), None)
        if first:
            found.append(first.attrs.get("datetime") or first.text())
    return [d for d in found if d] + [t for n in nodes if n.tag == "p" and DAY.match(t := n.text())]


def _twin(base: str, href: str) -> str:
    """The form by which links to the same page are told, however they are written."""
    if not href:
        return ""
    u = urlsplit(urljoin(base, href))
    return urlunsplit(("https" if u.scheme in ("", "http") else u.scheme, u.netloc.lower(), u.path.rstrip("/"), u.query, u.fragment))


def listing_entries(markup: str, base: str = "") -> list[tuple[str, str, list[str], str]]:
    """(title, href, candidate dates, text) of the items of a listing page; its plain links where it has none."""
    nodes = list(Tree(markup).root.walk())
    out, seen = [], set()
    for tag, name in CONTAINERS:
        for box in (n for n in nodes if n.tag == tag and (not name or n.has(name))):
            link = _title_link(box)
            title, href = (link.text(), (link.attrs.get("href") or "").strip()) if link else ("", "")
            if not (title or href) or (_twin(base, href), title) in seen:
                continue
            seen.add((_twin(base, href), title))
            first = next((n for n in box.walk() if n.tag == "p" or n.tag == "div" and (n.has("description") or n.has("text")) or n.tag == "span" and n.has("description")), None)
            out.append((title, href, _dates(box), first.text() if first else ""))
        if len(out) >= ENOUGH:
            return out
    if not out:
        for n in nodes:
            href = (n.attrs.get("href") or "").strip()
            if n.tag == "a" and usable(href) and (title := n.text()) and (_twin(base, href), title) not in seen:
                seen.add((_twin(base, href), title))
                out.append((title, href, [d for s in n.parent.walk() if s.tag in ("span", "time", "em") and (d := s.attrs.get("datetime") or s.text())], ""))
    return out



def plain(portal, base, content, reader):
    return [(portal, k, t, urljoin(base, h) if h else "", text_nodes(b)) for k, (t, h, d, b) in enumerate(reader(content or "", base))]


def normal(url):
    u = urlsplit(url)
    path = re.sub("/+$", "", re.sub(r";[^/]*$", "", u.path))
    return f"{'https' if u.scheme == 'http' else u.scheme}://{u.netloc.lower()}{path}" + (f"?{u.query}" if u.query else "") + (f"#{u.fragment}" if u.fragment else "") if url else ""


def markup(rng, depth=0):
    """Tags that are closed, left open, closed twice or crossed, with the names that listings use."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["div", "div", "article", "li", "p", "h2", "h3", "a", "a", "a", "span", "time", "em", "br", "script"])
        name = rng.choice(["", "", "newsItem", "item", "title", "date", "entry x", "description", "text"])
        attrs = f' class="{name}"' if name else ""
        if tag == "a":
            attrs += rng.choice([' href="/n/%d"' % rng.randrange(6), ' href=" HTTP://G.example/n/%d/"' % rng.randrange(3), ' href="#"', "", ' href="javascript:x"', ' href="?p=1;q"'])
        if tag == "time":
            attrs += rng.choice([' datetime="2021-03-04"', ""])
        inner = rng.choice(["", "T%d" % rng.randrange(4), "5/6/2021 x", " a &amp; b ", "&lt;b&gt;c", "01/02/2020"]) + (markup(rng, depth + 1) if depth < 3 and tag != "script" else "")
        out.append(f"<{tag}{attrs}>{inner}" + rng.choice([f"</{tag}>"] * 6 + ["", f"</{tag}></div>", "</li>"]))
    return "".join(out)


def listings(spark, pairs):
    return spark.createDataFrame([(p, "IF", b, c) for p, b, c in pairs], "portal string, instituicao string, base string, conteudo string")


def test_listings_match_a_plain_reading(spark):
    rng = random.Random(5)
    pages = [(str(i), "https://g.example/x/", markup(rng)) for i in range(300)] + [("none", "https://g.example", None), ("blank", "https://g.example", "")]
    got = items.parse_listings(listings(spark, pages)).collect()
    want = [row for p, b, c in pages for row in plain(p, b, c, listing_entries)]
    assert len(want) > 300
    assert sorted((r.portal, r.ordem, r.titulo, r.url, r.texto) for r in got) == sorted((p, k, t, normal(u), x) for p, k, t, u, x in want)


def test_feeds_match_a_plain_reading(spark):
    rng = random.Random(6)

    def feed(kind):
        def item():
            names = ["title", "link", "guid", "pubDate", "dc:date", "description", "content:encoded", "updated", "published", "summary", "content"]
            body = "".join(f"<{n}{rng.choice(['', ' href=\'/h\''])}>{rng.choice(['', ' ', 'v%d' % rng.randrange(5), 'a <i>b</i> c', '&lt;a href=&quot;/q&quot;&gt;z&lt;/a&gt; &amp;amp;', '/l/%d' % rng.randrange(3)])}</{n}>" for n in rng.sample(names, rng.randrange(6)))
            tag = "entry" if kind == "feed" else "item"
            return f"<{tag} rdf:about='/about'>{body}</{tag}>"

        inner = "".join(item() for _ in range(rng.randrange(4)))
        spaces = 'xmlns:rdf="r" xmlns:dc="d" xmlns:content="c"'
        return f"<?xml version='1.0' encoding='UTF-8'?>\n<{kind} {spaces}>{'<channel>' if kind == 'rss' else ''}{inner}{'</channel>' if kind == 'rss' else ''}</{kind}>" + rng.choice([""] * 9 + ["<x"])

    feeds = [(str(i), "https://g.example/x/", feed(rng.choice(["rss", "rdf:RDF", "feed"]))) for i in range(200)] + [("none", "https://g.example", None)]
    got = items.parse_feeds(listings(spark, feeds)).collect()
    want = [row for p, b, c in feeds for row in plain(p, b, c, feed_entries)]
    assert len(want) > 150 and sorted((r.portal, r.ordem, r.titulo, r.url, r.texto) for r in got) == sorted((p, k, t, normal(u), x) for p, k, t, u, x in want)


def test_an_encoding_that_the_text_no_longer_has_is_ignored(spark):
    feed = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>Maré</title></item></channel></rss>'
    assert [r.titulo for r in items.parse_feeds(listings(spark, [("a", "https://g.example", feed)])).collect()] == ["Maré"]
