"""Markup as an array of its nodes, in document order.

Only cutting markup into nodes happens in Python, in Arrow batches. What is looked for among them is written
as expressions over the array: what stands in a node are the nodes from behind it to its `last`.
"""

from __future__ import annotations

from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.binding import in_slices

#: A node: an element, or a piece of text (tag ''). parent and heading are places, -1 where there is none; heading is the nearest of HEADINGS around it.
NODES = "array<struct<place int, last int, parent int, heading int, tag string, names array<string>, href string, datetime string, text string>>"
#: Where a listing's title is looked for. Fixed values.
HEADINGS = ("h2", "h3", "h4", "p")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = ("script", "style")
_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_LOCAL = pa.list_(pa.struct([
    ("place", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("heading", pa.int32()), ("tag", pa.string()), ("names", pa.list_(pa.string())), ("href", pa.string()), ("datetime", pa.string()), ("text", pa.string()),
]))


class _Nodes:
    """Collects nodes; an end tag closes the nearest open element of its name, and what is open inside it."""

    def __init__(self):
        self.found: list[dict] = []
        self.around: list[dict] = []

    def _add(self, tag: str, attrs: dict, text: str) -> dict:
        place, up = len(self.found), self.around[-1] if self.around else None
        heading = -1 if up is None else up["place"] if up["tag"] in HEADINGS else up["heading"]
        node = {
            "place": place, "last": place, "parent": up["place"] if up else -1, "heading": heading, "tag": tag, "names": (attrs.get("class") or "").split(),
            "href": (attrs.get("href") or attrs.get("about") or "").strip(), "datetime": attrs.get("datetime") or "", "text": text,
        }
        self.found.append(node)
        return node

    def start(self, tag: str, attrs: dict) -> None:
        tag = tag.rpartition("}")[2]
        self.around.append(self._add(tag, {k.rpartition("}")[2]: v for k, v in attrs.items()}, ""))

    def end(self, tag: str) -> None:
        tag = tag.rpartition("}")[2]
        if any(n["tag"] == tag for n in reversed(self.around)):
            while True:
                node = self.around.pop()
                node["last"] = len(self.found) - 1
                if node["tag"] == tag:
                    return

    def data(self, text: str) -> None:
        self._add("", {}, text)

    def close(self) -> list[dict]:
        for node in self.around:
            node["last"] = len(self.found) - 1
        return self.found


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.silent = _Nodes(), 0

    def handle_starttag(self, tag, attrs):
        self.nodes.start(tag, dict(attrs))
        self.silent += tag in _SILENT
        if tag in _VOID:
            self.nodes.end(tag)

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0
        if tag not in _VOID:
            self.nodes.end(tag)

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.nodes.data(data.strip())


def _of_html(markup: str) -> list[dict]:
    reader = _Html()
    reader.feed(markup)
    reader.close()
    return reader.nodes.close()


def _of_xml(markup: str) -> list[dict]:
    try:
        reader = ElementTree.XMLParser(target=_Nodes(), encoding="utf-8")
        reader.feed(markup.strip().encode())
        return reader.close()
    except (ElementTree.ParseError, ValueError):
        return []


def _by(reader):
    return F.arrow_udf(lambda values: in_slices(values, reader, _LOCAL), NODES)


def html_nodes(markup: Column) -> Column:
    """NODES of lenient HTML. Texts are trimmed, blank ones and those of scripts and styles are left out. Null stays null."""
    return _by(_of_html)(markup)


def xml_nodes(markup: Column) -> Column:
    """NODES of XML, with names without their prefixes and texts as they are; empty where it is malformed. Null stays null."""
    return _by(_of_xml)(markup)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def inside(nodes: Column, node: Column) -> Column:
    """The nodes inside a node."""
    return F.slice(nodes, node["place"] + 2, node["last"] - node["place"])


def joined(nodes: Column, between: str = " ") -> Column:
    """The texts among nodes, joined."""
    return F.array_join(F.transform(F.filter(nodes, lambda n: n["tag"] == ""), lambda n: n["text"]), between)


def usable(href: Column) -> Column:
    """Whether a link leads to a page."""
    return (href != "") & ~href.startswith("#") & ~F.lower(href).startswith("javascript:")
