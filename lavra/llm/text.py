"""Column functions on whole texts, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, wherever nothing else is agreed.
SHINGLE_WORDS = 5


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df, in any case of letters, has it."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words, split at any white space; null and blank texts have none."""
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+")
    return F.filter(pieces, lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of every run of `size` words, in order, with repeats.

    A text of fewer words is one shingle; a text without words has none.
    """

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        runs = F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))),
        )
        return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)
