"""Text functions: white space, markup, folding, labels. Null counts as empty throughout."""

from __future__ import annotations

import html
import sys
import unicodedata
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.binding import in_slices, let


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapse_ws(text: Column) -> Column:
    """Runs of Unicode white space and of the separators \\x1c-\\x1f become one blank; trimmed."""
    return F.trim(F.regexp_replace(_or_empty(text), r"(?U)[\s\x1c-\x1f]+", " "))


def strip_tags(text: Column) -> Column:
    """Every `<...>` becomes a blank."""
    return F.regexp_replace(_or_empty(text), r"<[^>]+>", " ")


class _Texts(HTMLParser):
    """Collects trimmed text nodes; what scripts, styles and comments hold is no text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.parts.append(data.strip())


def text_nodes(markup: str) -> str:
    """The text nodes of markup, each trimmed, joined by blanks."""
    reader = _Texts()
    reader.feed(markup)
    reader.close()
    return " ".join(reader.parts)


def _by_value(texts: Column, of) -> Column:
    """of(value) for values that are not null, in Arrow batches."""
    return F.arrow_udf(lambda values: in_slices(values, of, pa.string()), T.StringType())(texts)


def unescape(text: Column) -> Column:
    """Character references decoded once. Only texts with an `&` leave the JVM."""
    return F.coalesce(_by_value(F.when(F.contains(text, F.lit("&")), text), html.unescape), _or_empty(text))


def clean_html(text: Column, mode: str = "regex") -> Column:
    """Plain text: tags out, references decoded, white space collapsed; never shortened.

    Mode `regex` blanks everything in angle brackets, scripts' text stays. Mode `parser` keeps text nodes
    only and so decodes references twice. Texts without `<` and `&` stay native in both.
    """
    t = _or_empty(text)
    if mode == "regex":
        return collapse_ws(unescape(strip_tags(t)))
    if mode != "parser":
        raise ValueError(f"mode must be 'regex' or 'parser', not {mode!r}")
    marked = F.when(F.contains(t, F.lit("<")) | F.contains(t, F.lit("&")), t)
    return collapse_ws(F.coalesce(_by_value(marked, lambda m: html.unescape(text_nodes(m))), t))


@lru_cache(maxsize=1)
def _marks() -> str:
    """A pattern of the combining marks, as ranges."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    starts = [c for c, before in zip(marks, [-1, *marks]) if c != before + 1]
    ends = [c for c, after in zip(marks, [*marks[1:], -1]) if c != after - 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


def _without_marks(texts: pa.Array) -> pa.Array:
    """Each distinct text of a batch decomposed, and without its combining marks."""
    coded = texts.dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_normalize(coded.dictionary, form="NFKD"), pattern=_marks(), replacement="")
    return bare.take(coded.indices)


def fold_upper(text: Column) -> Column:
    """Compatibility-decomposed, without combining marks, upper-cased; white space is left alone.

    Plain ASCII stays native.
    """
    t = _or_empty(text)
    return F.upper(F.coalesce(F.arrow_udf(_without_marks, T.StringType())(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(_or_empty(text), r"\D", "")


def valid_tax_id(text: Column) -> Column:
    """Whether exactly 14 digits remain."""
    return F.char_length(digits_only(text)) == 14


def split_labels(joined: Column) -> Column:
    """Non-blank trimmed parts of a `|`-joined list."""
    parts = F.transform(F.split(_or_empty(joined), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def main_label(joined: Column) -> Column:
    return F.coalesce(F.get(split_labels(joined), F.lit(0)), F.lit(""))


def other_labels(joined: Column) -> Column:
    """All labels but the first, joined again."""
    labels = split_labels(joined)
    return F.when(F.size(labels) > 1, F.array_join(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(1))), "|")).otherwise("")


def join_title_abstract(title: Column, abstract: Column, mode: str = "regex") -> Column:
    return F.trim(F.concat_ws(" ", clean_html(title, mode), clean_html(abstract, mode)))


@lru_cache(maxsize=1)
def _windows_1252() -> tuple[str, str, str]:
    """The characters that bytes 128 to 159 are in ISO-8859-1, what they are in Windows-1252 instead, and those it leaves undefined."""
    decoded = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(128, 160)}
    return "".join(c for c, d in decoded.items() if d), "".join(decoded.values()), "".join(c for c, d in decoded.items() if not d)


def repair_encoding(data: Column) -> Column:
    """Binary to text: UTF-8, else Windows-1252 where all its bytes are defined, else UTF-8 with replacements."""
    text = data.cast("string")
    there, instead, undefined = _windows_1252()
    western = lambda c: F.when(c.rlike(f"[{undefined}]"), F.call_function("make_valid_utf8", text)).otherwise(F.translate(c, there, instead))
    return F.when(F.call_function("is_valid_utf8", text), text).when(data.isNotNull(), let(F.decode(data, "ISO-8859-1"), western))
