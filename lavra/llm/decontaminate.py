"""Benchmark decontamination: exact and near matches from a distributed positional inverted index.

The words of the benchmark are the terms. The index holds, for each term and each training text that has
it, the places where it stands; it is one table, written once, and all that is ever asked of the texts.
A phrase is looked up from its rarest term on: that term's places, less its offset in the phrase, are where
the phrase may begin; they are intersected with the places of the second rarest term, less its offset, and
what is left with those of all other terms. Terms are never looked up in the order of the text, so
frequent words cost what the rare words next to them leave.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.llm.text import unused
from lavra.sources.scratch import written

#: Consecutive words that make a contamination.
WINDOW_WORDS = 10
#: For near matches: how far from the rarest word of a window its other words may stand.
REACH = 20
#: No word holds it: the mark of the index row that stands for a text itself.
_TEXT = "\x00"


class Index(NamedTuple):
    """texts: (row, id, n_words), one for each text. postings: (row, term, pos). phrases: (phrase, words, terms). members: (phrase, item)."""

    texts: DataFrame
    postings: DataFrame
    phrases: DataFrame
    members: DataFrame


def _lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; words are ASCII more often than not, and those take the fast way."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, capitals, capitals.lower()))


def raw_words(text: Column) -> Column:
    """array<string>: the runs of digits, letters a-z and A-Z, and characters beyond ASCII, as they stand."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.filter(pieces, lambda w: w != "")


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Index:
    """The positional index of docs for the words of items.

    Items of equal words are one phrase. Texts are read once and nothing of them is shuffled, unless the
    table of terms is too large for the planner to broadcast. Each row of docs gets a number of its own,
    which holds as the index is written.
    """
    in_words = F.transform(raw_words(F.col(item_text_col)), _lowered)
    worded = items.select(F.col(item_col).cast("string").alias("item"), in_words.alias("words")).where(F.size("words") > 0)
    phrases = written(worded.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), "phrases")
    members = phrases.join(worded, "words").select("phrase", "item").distinct()
    terms = written(phrases.select(F.explode("words").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), raw_words(F.col(text_col)).alias("words"))
    marked = numbered.select("row", "id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit(_TEXT)), F.col("words"))).alias("pos", "word"))
    known = terms.unionByName(docs.sparkSession.range(1).select(F.lit(_TEXT).alias("word"), F.lit(-1).cast("long").alias("term")))
    found = marked.withColumn("word", _lowered(F.col("word"))).join(known, "word")
    text = F.col("term") < 0
    # One table for both, so that a text is split once: a text's own row holds its id, and its length as place.
    index = written(found.select("row", "term", F.when(text, F.col("n")).otherwise(F.col("pos") - 1).alias("pos"), F.when(text, F.col("id")).alias("id")), "index")

    spelled = phrases.select("phrase", F.posexplode("words").alias("at", "word")).join(terms, "word")
    in_terms = spelled.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("t")).select("phrase", F.col("t.term").alias("terms"))
    return Index(
        index.where(text).select("row", "id", F.col("pos").cast("long").alias("n_words")),
        index.where(~text).select("row", "term", "pos"),
        written(phrases.join(in_terms, "phrase"), "spelled"), members,
    )


def _windows(index: Index, size: int) -> DataFrame:
    """Rows (phrase, start, rare): the windows all whose terms occur, with the (frequency, at, term) of their terms from the rarest on."""
    frequency = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rated = index.phrases.select("phrase", F.posexplode("terms").alias("at", "term")).join(frequency, "term", "left")
    rated = rated.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - size, F.lit(0)))
    by_rarity = lambda s: F.array_sort(F.transform(F.slice("t", s + 1, F.lit(size)), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term"))))
    windows = rated.select("phrase", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), by_rarity(s).alias("rare")))).alias("w"))
    return written(windows.select("phrase", "w.*").where(F.get("rare", F.lit(0))["n"] > 0), "windows")


def exact_matches(index: Index, size: int = WINDOW_WORDS) -> DataFrame:
    """Rows (row, phrase, shift, starts): the windows of `size` words of a phrase that stand in a text in full.

    A window that starts at s in the phrase stands at shift + s in the text. A phrase of fewer words is one
    window. Lists are intersected by (row, place, term): no text, term or phrase is a key by itself, so none
    is too common for one task.
    """
    rare = lambda k: F.get("rare", F.lit(k))
    # Windows of one word have no second term: the first stands in.
    pairs = _windows(index, size).select("phrase", rare(0).alias("a"), F.coalesce(rare(1), rare(0)).alias("b"))
    pairs = written(pairs.select("phrase", F.col("a.at").alias("a_at"), F.col("a.term").alias("term"), F.col("b.at").alias("b_at"), F.col("b.term").alias("b_term")).distinct(), "rarest")
    probes = index.postings.join(pairs, "term").select("row", "phrase", (F.col("pos") - F.col("a_at")).alias("shift"), F.col("b_term").alias("term"), (F.col("pos") - F.col("a_at") + F.col("b_at")).alias("pos"))
    begun = written(probes.join(index.postings, ["row", "pos", "term"], "left_semi").select("row", "phrase", "shift").distinct(), "begun")
    spelled = index.phrases.select("phrase", F.posexplode("terms").alias("at", "term"))
    asked = begun.join(spelled, "phrase").select("row", "phrase", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
    there = asked.join(index.postings, ["row", "pos", "term"], "left_semi")
    placed = there.groupBy("row", "phrase", "shift").agg(F.sort_array(F.collect_list("at")).alias("at"))
    sized = placed.join(index.phrases.select("phrase", F.least(F.size("terms"), F.lit(size)).alias("n")), "phrase")
    # In a sorted list of places, n in a row are n - 1 apart.
    whole = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("at") - F.col("n")), lambda k: F.get("at", k + F.col("n") - 1) == F.get("at", k) + F.col("n") - 1), lambda k: F.get("at", k)
    )
    full = sized.where(F.size("at") >= F.col("n")).select("row", "phrase", "shift", "n", whole.alias("starts"))
    return full.where(F.size("starts") > 0)


def near_matches(index: Index, size: int = WINDOW_WORDS, reach: int = REACH) -> DataFrame:
    """Rows (row, phrase), distinct: some place of a window's rarest term has all its other terms within `reach` words.

    Order and repetitions of words don't count; exact matches are among them if reach >= size - 1. Of
    equally rare terms the first is the rarest.
    """
    terms = lambda rare: F.array_distinct(F.transform(rare, lambda x: x["term"]))
    windows = written(_windows(index, size).select("phrase", terms(F.col("rare")).alias("terms")).distinct().select(F.monotonically_increasing_id().alias("window"), "phrase", "terms"), "term-sets")
    starts = windows.select("window", F.get("terms", F.lit(0)).alias("term"), F.coalesce(F.get("terms", F.lit(1)), F.get("terms", F.lit(0))).alias("b_term"))
    near = F.floor(F.col("pos") / reach)
    blocks = lambda asked: asked.withColumn("block", F.explode(F.sequence(F.floor((F.col("p") - reach) / reach), F.floor((F.col("p") + reach) / reach))))
    listed = index.postings.withColumn("block", near)

    def found(asked: DataFrame) -> DataFrame:
        """asked (row, window, p, term): of these, the rows that have the term within reach of p."""
        close = F.abs(F.col("pos") - F.col("p")) <= reach
        return blocks(asked).join(listed, ["row", "term", "block"]).where(close).select("row", "window", "p", "term").distinct()

    first = index.postings.join(starts, "term").select("row", "window", F.col("pos").alias("p"), F.col("b_term").alias("term"))
    begun = written(found(first).select("row", "window", "p"), "begun")
    rest = windows.select("window", F.explode("terms").alias("term"))
    counted = found(begun.join(rest, "window")).groupBy("row", "window", "p").agg(F.count(F.lit(1)).alias("n"))
    full = counted.join(windows.select("window", "phrase", F.size("terms").alias("all")), "window").where(F.col("n") == F.col("all"))
    return full.select("row", "phrase").distinct()


def contamination(index: Index, size: int = WINDOW_WORDS) -> DataFrame:
    """One row for each text: id, n_words, n_hit, n_items, items and contaminated.

    n_hit counts the words inside an occurrence of a window; items are the ids, as sorted strings, of the
    items with such an occurrence. An item without an id counts as a hit but is in no list.
    """
    matches = written(exact_matches(index, size), "matches")
    inside = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("n") - 1))))
    words = matches.select("row", F.explode(F.transform(inside, lambda i: i + F.col("shift"))).alias("pos")).distinct()
    hits = words.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = matches.select("row", "phrase").distinct().join(index.members, "phrase").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = index.texts.join(hits, "row", "left").join(listed, "row", "left")
    return joined.select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """docs without the rows whose text holds a window of an item; rows without an id are judged by their text too."""
    key, bad = unused(docs, "key", "bad")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col)))
    judged = contamination(build_index(keyed.select(F.col(key).alias("k"), F.col(text_col).alias("t")), items, "k", "t", item_col, item_text_col), size)
    dirty = judged.where("contaminated").select(F.col("id").alias(bad)).distinct()
    return keyed.join(dirty, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)
