"""Periodic runs of words, found with a dictionary of basic factors.

For every power of two the dictionary names the factors of so many words: equal names, equal words. A
name of 2m words is the pair of names of its two halves, so each level is one sort of what recurs in
its document at the level below; what recurs nowhere is forgotten. A run of period q repeats the factor
of m words at its start, m being the largest power of two up to q, q words later. So at each level the
occurrences from m to 2m words further on propose periods. They form an arithmetic progression, of
which all terms but the first have the same word before them: a run cannot start where the word before
both places is the same, so a progression is spelled out only where one starts. Proposals are extended
to the right by the dictionary itself, from long factors to short ones, and of proposals that give the
same stretch the smallest period stays. All this takes O(n log n) for a document of n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words in the shortest run.
LEAST_WORDS = 12
#: Factors of this length serve all periods below twice it: LEAST_WORDS leaves room for them.
_SMALL = 4
#: Words that a task handles at once; a longer text is handled alone.
WORDS_AT_ONCE = 400_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _next_level(names: np.ndarray, half: int, end: np.ndarray, doc: np.ndarray) -> np.ndarray | None:
    """Names of the factors of 2 * half words from those of `half`; -1 where one recurs nowhere in its document."""
    at = np.flatnonzero(names >= 0)
    at = at[at + 2 * half <= end[at]]
    at = at[names[at + half] >= 0]
    if not len(at):
        return None
    pair = names[at].astype(np.int64) * (int(names.max()) + 1) + names[at + half]
    order = np.argsort(pair, kind="stable")
    pair, at = pair[order], at[order]
    new = np.r_[True, pair[1:] != pair[:-1]]
    again = ~new & np.r_[False, doc[at[1:]] == doc[at[:-1]]]
    recurs = again | np.r_[again[1:], False]
    if not recurs.any():
        return None
    out = np.full(len(names), -1, np.int32)
    out[at[recurs]] = np.cumsum(new)[recurs]
    return out


def _proposals(codes: np.ndarray, names: np.ndarray, m: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (s, t) of equal factors of m words, m to 2m words apart, which no word before both extends to the left."""
    at = np.flatnonzero(names >= 0)
    width = len(names) + 1
    order = np.argsort(names[at], kind="stable")
    at = at[order]
    key = names[at].astype(np.int64) * width
    places = key + at
    low = np.searchsorted(places, key + at + m)
    count = np.searchsorted(places, key + np.minimum(at + 2 * m, end[at])) - low
    found = count > 0
    s, low, count = at[found], low[found], count[found]
    t = at[low]
    open_left = lambda s, t: (s == start[s]) | (codes[s - 1] != codes[t - 1])
    first = open_left(s, t)
    # Further terms of the progression share the word before them.
    more = np.flatnonzero(count > 1)
    more = more[open_left(s[more], at[low[more] + 1])]
    times = count[more] - 1
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.r_[s[first], np.repeat(s[more], times)], np.r_[t[first], at[np.repeat(low[more] + 1, times) + step]]


def _small_proposals(codes: np.ndarray, names: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _proposals, for all periods below 2 * _SMALL."""
    at = np.flatnonzero(names >= 0)
    found = []
    for q in range(1, 2 * _SMALL):
        s = at[at + q < end[at]]
        s = s[names[s] == names[s + q]]
        found.append((s[(s == start[s]) | (codes[s - 1] != codes[s + q - 1])], q))
    return np.concatenate([s for s, _ in found]), np.concatenate([s + q for s, q in found])


def _extended(levels: list[np.ndarray], s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many words from s on equal those from t on, in the document; s lies before t."""
    size = len(levels[0])
    same = np.zeros(len(s), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, going = levels[k], np.arange(len(s))
        while len(going):
            a, b = s[going] + same[going], t[going] + same[going]
            going, a, b = going[b < size], a[b < size], b[b < size]
            going = going[(names[a] == names[b]) & (names[a] >= 0)]
            same[going] += 1 << k
    return same


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; starts count from the front of codes.

    codes: a number from 0 for each distinct word. Document i is codes[bounds[i] : bounds[i + 1]]. A run
    is a stretch of smallest period q and of max(least, 2q) words or more that no neighbouring word of its
    document extends. `least` is at least 3 * _SMALL - 1.
    """
    if least < 3 * _SMALL - 1:
        raise ValueError(f"runs of fewer than {3 * _SMALL - 1} words need shorter factors")
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    start, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    # Level 0 keeps the end of a document apart from the next one's words by the document's number.
    levels, m, found = [codes.astype(np.int32)], 1, []
    while 2 * m <= max(_SMALL, int(sizes.max(initial=0)) // 2):
        names = _next_level(levels[-1], m, end, doc)
        if names is None:
            break
        levels.append(names)
        m *= 2
        if m == _SMALL:
            found.append(_small_proposals(codes, names, start, end))
        elif m > _SMALL:
            found.append(_proposals(codes, names, m, start, end))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, t = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    inside = start[s] == start[t]
    s, t = s[inside], t[inside]
    period = t - s
    same = np.minimum(_extended(levels, s, t), end[t] - t)
    length = period + same
    whole = length >= np.maximum(least, 2 * period)
    s, length, period = s[whole], length[whole], period[whole]
    order = np.lexsort((period, length, s))
    s, length, period = s[order], length[order], period[order]
    smallest = np.r_[True, (s[1:] != s[:-1]) | (length[1:] != length[:-1])] if len(s) else np.zeros(0, bool)
    s, length, period = s[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, s))
    return s[order], length[order], period[order]


def _groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    few, size = [], 0
    for text in texts:
        # bytes.split() takes exactly the blank and the bytes 9 to 13 as white space.
        words = (text or b"").split()
        if few and size + len(words) > WORDS_AT_ONCE:
            yield few
            few, size = [], 0
        few.append(words)
        size += len(words)
    yield few


def _columns(texts: list[list[bytes]], least: int) -> list[pa.Array]:
    flat = [w for words in texts for w in words]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(words) for words in texts], out=bounds[1:])
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start, length, period = find_runs(codes, bounds, least)
    # What stands in a run after its first period: +1 where that begins, -1 where it ends.
    edges = np.zeros(len(flat) + 1, np.int32)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    owner = np.searchsorted(bounds, start, side="right") - 1
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    collapsed = []
    for i, words in enumerate(texts):
        if offsets[i] < offsets[i + 1]:
            words = [words[j] for j in np.flatnonzero(kept[bounds[i] : bounds[i + 1]])]
        collapsed.append(b" ".join(words))
    rows = pa.StructArray.from_arrays([pa.array(start - bounds[owner]), pa.array(length), pa.array(period)], names=RUN.names)
    return [pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(collapsed, pa.binary())]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Rows (id, n_words, runs, collapsed), one for each row of docs.

    Words are what stands between blanks, tabs and line breaks (`[^\\x20\\x09-\\x0D]+`), numbered from 0.
    runs: array<struct<start, length, period>> by start, then period. collapsed: the words that no run
    holds after its first period, joined by blanks. Null, empty and blank texts have no words, no runs
    and an empty collapsed text. Rows that repeat are separate rows with equal results; other columns,
    whatever their names, are not carried.

    Nothing is shuffled: a row is one document, handled whole, in memory linear in its words.
    """
    fields = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for few in _groups(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(few)), *_columns(few, least)], names=fields.names)
                at += len(few)

    found = docs.select(id_col, docs[text_col].cast("binary").alias("__bytes")).mapInArrow(run, fields)
    return found.withColumn("collapsed", found["collapsed"].cast("string"))
