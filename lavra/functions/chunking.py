"""Whole-paragraph chunks."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.binding import let

TARGET_TOKENS = 400
CHARS_PER_TOKEN = 4
NO_SOURCE = "(sem fonte)"


def target_chars(tokens: int | None = None) -> int:
    """Characters in a chunk; 0 and None stand for the usual target, negative ones for a single character."""
    return max(1, int((tokens or TARGET_TOKENS) * CHARS_PER_TOKEN))


def split_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, white space collapsed, without empty ones; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n(?U:\s*)\n+")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?U)[\s\x1c-\x1f]+", " ")))
    return F.filter(clean, lambda p: p != "")


def _ends(most: int):
    """From the sizes of paragraphs to where chunks end: over the prefix sums of a whole batch, a jump for each chunk."""

    def ends(sizes: pa.Array) -> pa.Array:
        total = memoryview(np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(), dtype=np.int64)]))
        rows, at = [], 0
        for n in pc.fill_null(pc.list_value_length(sizes), 0).to_pylist():
            first, last, found = at, at + n, []
            while at < last:
                at = max(at + 1, bisect_right(total, total[at] + most, at + 1, last + 1) - 1)
                found.append(at - first)
            rows.append(found)
        return pa.array(rows, pa.list_(pa.int32()))

    return F.arrow_udf(ends, T.ArrayType(T.IntegerType()))


def pack_chunks(paragraphs: Column, tokens: int | None = None) -> Column:
    """Chunks of whole paragraphs: one is closed where the next would take it past the target.

    Sizes are of the paragraphs, without the blanks between them; a longer paragraph stands alone. Only the
    sizes leave the JVM, and all steps are linear in the paragraphs. Give a column: it is read twice.
    """
    ends = _ends(target_chars(tokens))(F.transform(paragraphs, lambda p: F.char_length(p)))

    def between(bounds: Column) -> Column:
        join = lambda end, i: F.array_join(F.slice(paragraphs, F.get(bounds, i) + 1, end - F.get(bounds, i)), " ")
        return F.transform(F.slice(bounds, F.lit(2), F.size(bounds) - 1), join)

    return let(F.concat(F.array(F.lit(0)), ends), between)


def chunk_key(source: Column, index: Column) -> Column:
    return F.concat(F.when(F.trim(F.coalesce(source, F.lit(""))) == "", NO_SOURCE).otherwise(source), F.lit("::"), index.cast("string"))
