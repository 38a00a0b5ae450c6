"""URLs as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.binding import let

# RFC 3986, appendix B.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Schemes whose addresses have hosts and paths.
HIERARCHICAL = ("http", "https", "ftp", "sftp", "file", "ws", "wss")
_SPACES = "".join(map(chr, range(33)))


def _canonical(url: Column, path_of) -> Column:
    def of(u: Column) -> Column:
        part = lambda k: F.regexp_extract(u, "(?s)" + _PARTS, k)
        scheme = F.lower(part(1))
        whole = F.concat(
            F.when(scheme.isin("", "http"), "https").otherwise(scheme), F.lit("://"), F.lower(part(2)), F.regexp_replace(path_of(part(3)), "/+$", ""),
            F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise(""), F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise(""),
        )
        return F.when(u == "", "").otherwise(whole)

    return let(F.coalesce(url, F.lit("")), of)


def normalize_url(url: Column) -> Column:
    """The form by which equal pages are told: https for http or none, lower-case host, no trailing slashes.

    Parameters of the last path segment go; query and fragment stay, unless empty. Empty stays empty.
    """
    return _canonical(url, lambda path: F.regexp_replace(path, r";[^/]*$", ""))


def _resolved_path(base_path: Column, path: Column) -> Column:
    """path beside the last segment of base_path, unless it begins with a slash; `.` and `..` segments resolved."""
    beside = F.concat(F.regexp_replace(F.regexp_replace(base_path, "[^/]*$", ""), "(?<!^)/+", "/"), path)

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    def walked(segments: Column) -> Column:
        last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.aggregate(segments, F.array().cast("array<string>"), step), last), "/")

    return F.coalesce(let(let(F.split(F.when(path.startswith("/"), path).otherwise(beside), "/", -1), walked), lambda p: F.when(p != "", p)), F.lit("/"))


def absolute_url(base: Column, href: Column) -> Column:
    """href relative to base by RFC 3986, with schemes in lower case; blank hrefs are blank, blank bases change nothing.

    Paths of hrefs with a scheme of their own or a host are left as they are. So are hrefs whose scheme has no
    hierarchy, such as `mailto:`, and any href where the base has such a scheme.
    """

    def parts(url: Column) -> Column:
        names = ("scheme", "host", "path", "query", "fragment")
        of = lambda u: F.struct(u.alias("url"), *(F.regexp_extract(u, "(?s)" + _PARTS, k).alias(n) for k, n in enumerate(names, 1)))
        return let(url, of)

    def of(b: Column, h: Column) -> Column:
        scheme = F.lower(F.when(h["scheme"] != "", h["scheme"]).otherwise(b["scheme"]))
        own, empty = h["host"] != "", h["path"] == ""
        host = F.when(own, h["host"]).otherwise(b["host"])
        path = F.when(own, h["path"]).when(empty, b["path"]).otherwise(_resolved_path(b["path"], h["path"]))
        query = F.when(~own & empty & (h["query"] == ""), b["query"]).otherwise(h["query"])
        rooted = lambda p: F.when((host != "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
        whole = F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), let(path, rooted),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(h["fragment"] != "", F.concat(F.lit("#"), h["fragment"])).otherwise(""),
        )
        apart = (b["url"] == "") | (scheme != F.lower(b["scheme"])) | ~scheme.isin("", *HIERARCHICAL)
        return F.when(h["url"] == "", "").when(apart, h["url"]).otherwise(whole)

    clean = lambda url: F.btrim(F.coalesce(url, F.lit("")), F.lit(_SPACES))
    return let(parts(clean(base)), lambda b: let(parts(F.regexp_replace(clean(href), "[\t\r\n]", "")), lambda h: of(b, h)))


def resolve_url(base: Column, href: Column) -> Column:
    """href relative to base, normalised; blank hrefs are blank."""
    return normalize_url(absolute_url(base, href))


def same_page(base: Column, href: Column) -> Column:
    """The form by which links to the same page are told; as normalised, but with the parameters of the path."""
    return _canonical(absolute_url(base, href), lambda path: path)


def item_key(url: Column, title: Column, institution: Column, date: Column) -> Column:
    """Key of a news item: its URL, or without one its title, institution and date."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rest = F.concat(F.lit("semurl:"), low(title), F.lit("|"), low(institution), F.lit("|"), F.trim(F.coalesce(date, F.lit(""))))
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), normalize_url(url))).otherwise(rest)
