"""Line dedup: content-defined chunks of lines.

Lines are hashed, and a rolling hash over the last line hashes decides where a chunk ends. So a passage
of lines gets the same chunk borders wherever it stands, whatever was inserted or removed before it.
Chunks of several lines that occur elsewhere, byte for byte, are removed but for the first occurrence.

Borders are sparse, so passages of a few lines fall between them. `drop_repeated_passages` therefore takes
the rolling hash over two neighbouring lines (in long lines: sentences) at every place, and puts the borders
where it stops repeating elsewhere, so that a repeated passage goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.llm.text import let, unused
from lavra.sources.scratch import written

#: Line hashes in the rolling hash.
WINDOW_LINES = 2
#: One line in 2**BORDER_BITS ends a chunk.
BORDER_BITS = 2
#: A line of so many words is cut into sentences, and a sentence of so many after one word in 2**WORD_BITS.
LONG_WORDS = 50
WORD_BITS = 3
_BLANKS = " \t\n\x0b\f\r"
_CUT = "\x01"


def line_chunks(text: Column, window: int = WINDOW_LINES, border_bits: int = BORDER_BITS) -> Column:
    """array<array<string>>: the lines of the text in chunks; joined by line feeds they are the text.

    The last line always ends a chunk. A null or empty text is one chunk of one empty line.
    """

    def cut(lines: Column) -> Column:
        def borders(hashes: Column) -> Column:
            n = F.size(hashes)
            rolled = lambda i: F.xxhash64(*(F.coalesce(F.get(hashes, i - k), F.lit(0).cast("long")) for k in range(window)))
            ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.shiftrightunsigned(rolled(i - 1), 64 - border_bits) == 0))
            return let(
                ends,
                lambda e: F.zip_with(
                    F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)), e,
                    lambda start, end: F.slice(lines, start + 1, end - start),
                ),
            )

        return let(F.transform(lines, lambda x: F.xxhash64(x)), borders)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def _several(lines: Column) -> Column:
    return (F.size(lines) > 1) & F.exists(lines, lambda x: F.trim(x) != "")


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES, border_bits: int = BORDER_BITS) -> DataFrame:
    """docs, with text shortened by the repeated chunks of several lines, and the ints removed_chunks and removed_lines.

    The first occurrence stays: that of the smallest id, and there the foremost. Chunks of one line and
    chunks of blank lines only are left alone. No row is dropped; a text all of whose chunks repeat
    becomes empty. A null text stays null. Rows equal in id and text are one document: they get equal
    results. Rows without an id come before all others. Columns of the result's names are replaced.

    Only hashes of chunks are compared across the corpus; then chunks whose hash repeats are compared as
    bytes, by grouping on the chunk itself. Groups are counted before they are shuffled, and a document
    gets back the places of its own chunks, so no task gathers the documents that share a chunk.
    """
    chunks = lambda text: line_chunks(text, window, border_bits)
    lean = docs.select(F.col(id_col).alias("k"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t")).where("t is not null")

    hashed = F.transform(chunks(F.col("t")), lambda c, i: F.struct(i.alias("pos"), F.when(_several(c), F.xxhash64(c)).alias("hash"), F.octet_length(F.array_join(c, "\n")).alias("bytes")))
    places = written(lean.select("k", "v", F.explode(F.filter(hashed, lambda c: c["hash"].isNotNull())).alias("c")).select("k", "v", "c.*").distinct(), "chunks")
    again = written(places.groupBy("hash", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeats")
    suspects = places.join(again, ["hash", "bytes"], "left_semi").groupBy("k", "v").agg(F.collect_list("pos").alias("places"))

    def suspected(text: Column) -> Column:
        return let(chunks(text), lambda cs: F.transform("places", lambda p: F.struct(p.alias("pos"), F.unhex(F.sha2(F.array_join(F.get(cs, p), "\n"), 256)).alias("same"))))

    drops = _later(_at_places(lean, suspects, suspected)).groupBy("k", "v").agg(F.collect_set("pos").alias("drops"))

    def rebuilt(text: Column, places: Column) -> Column:
        return let(
            chunks(text),
            lambda cs: let(
                F.transform(F.array_except(F.sequence(F.lit(0), F.size(cs) - 1), places), lambda p: F.get(cs, p)),
                lambda kept: F.struct(F.array_join(F.flatten(kept), "\n").alias("text"), F.size(places).alias("chunks"), (F.size(F.flatten(cs)) - F.size(F.flatten(kept))).alias("lines")),
            ),
        )

    return _shortened(docs, drops, id_col, text_col, rebuilt)


def _at_places(lean: DataFrame, suspects: DataFrame, of) -> DataFrame:
    """Rows (k, v, pos, same): what the text of lean (k, v, t) has at the places of suspects (k, v, places)."""
    s = written(suspects.withColumnsRenamed({"k": "s_k", "v": "s_v"}), "suspects")
    there = lean.join(s, F.col("k").eqNullSafe(F.col("s_k")) & (F.col("v") == F.col("s_v")))
    return written(there.select("k", "v", F.explode(of(F.col("t"))).alias("c")).select("k", "v", "c.*").distinct(), "compared")


def _later(compared: DataFrame) -> DataFrame:
    """The rows (k, v, pos, same) that are not the first of their `same`, with `first`, the place of that one.

    The firsts are a table of their own: the join then has an exchange on both sides, so that what a
    third of all rows share is split by the planner like any skewed key.
    """
    at = F.struct("k", "pos", "v")
    firsts = written(compared.groupBy("same").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "firsts")
    return compared.join(firsts, "same").where(~at.eqNullSafe(F.col("first")))


def _shortened(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str, rebuilt) -> DataFrame:
    """docs with rebuilt(text, drops), a struct<text, chunks, lines>, where drops (k, v, drops) has a row."""
    names = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    k, v, places, new = unused(docs, "k", "v", "drops", "new")
    gone = drops.withColumnsRenamed({"k": k, "v": v, "drops": places})
    joined = docs.select(*names).join(gone, F.col(id_col).eqNullSafe(F.col(k)) & (F.xxhash64(text_col) == F.col(v)), "left")
    done = joined.withColumn(new, F.when(F.col(places).isNotNull(), rebuilt(F.col(text_col), F.col(places))))
    return done.withColumns({
        text_col: F.coalesce(F.col(new)["text"], F.col(text_col)),
        "removed_chunks": F.coalesce(F.col(new)["chunks"], F.lit(0)),
        "removed_lines": F.coalesce(F.col(new)["lines"], F.lit(0)),
    }).select(*names, "removed_chunks", "removed_lines")


def _n_words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def _simple(text: Column) -> Column:
    """Whether single blanks and line feeds are its only white space, and _CUT isn't in it."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\x0b\f\r" + _CUT:
        odd = odd | F.contains(text, F.lit(c))
    return ~odd


def _by_spacing(text: Column, of) -> Column:
    """of(text, simple): what regular expressions do, string functions do for simple texts at a fraction of the cost."""
    t = F.coalesce(text, F.lit(""))
    return F.when(_simple(t), of(t, True)).otherwise(of(t, False))


def _long(text: Column, simple: bool) -> Column:
    """Whether the text has LONG_WORDS words."""
    if simple:
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "))) >= LONG_WORDS - 1
    return (F.octet_length(text) >= 2 * LONG_WORDS - 3) & (_n_words(text) >= LONG_WORDS)


def _trimmed(text: Column, simple: bool) -> Column:
    return F.trim(text) if simple else F.btrim(text, F.lit(_BLANKS))


def _pieces(line: Column, simple: bool) -> Column:
    """array<string>: a long line in sentences, and long sentences in runs of words; put together they are the line."""
    ends = lambda word: F.shiftrightunsigned(F.xxhash64(word), 64 - WORD_BITS) == 0

    def word_runs(sentence: Column) -> Column:
        if simple:
            marked = F.array_join(F.transform(F.split(sentence, " ", -1), lambda w: F.when(ends(w), F.concat(w, F.lit(_CUT))).otherwise(w)), " ")
            return F.split(F.replace(marked, F.lit(_CUT + " "), F.lit(" " + _CUT)), _CUT, -1)

        def cut(tokens: Column) -> Column:
            n = F.size(tokens)
            at = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ends(F.trim(F.get(tokens, i - 1))))
            return let(at, lambda e: F.zip_with(
                F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)), e, lambda start, end: F.array_join(F.slice(tokens, start + 1, end - start), ""),
            ))

        return let(F.split(sentence, r"(?<=\s)", -1), cut)

    if simple:
        marked = line
        for end in (". ", "! ", "? ", "。", "！", "？"):
            marked = F.replace(marked, F.lit(end), F.lit(end + _CUT))
        sentences = F.split(marked, _CUT, -1)
    else:
        sentences = F.split(line, r"(?<=[.!?]\s|[。！？])", -1)
    long = lambda s: _long(s, simple)
    cut = lambda ss: F.when(F.exists(ss, long), F.flatten(F.transform(ss, lambda s: F.when(long(s), word_runs(s)).otherwise(F.array(s))))).otherwise(ss)
    return F.filter(let(sentences, cut), lambda p: p != "")


def passage_units(text: Column) -> Column:
    """array<struct<piece, line, same>>: lines in order, those of LONG_WORDS words or more in pieces.

    The pieces of a line put together are the line; where they are cut depends only on what stands there.
    `same` is what is compared: the whole line, or the piece without the white space around it.
    """

    def units(t: Column, simple: bool) -> Column:
        def of(line: Column, i: Column) -> Column:
            whole = F.array(F.struct(line.alias("piece"), i.alias("line"), line.alias("same")))
            parts = F.transform(_pieces(line, simple), lambda p: F.struct(p.alias("piece"), i.alias("line"), _trimmed(p, simple).alias("same")))
            return F.when(_long(line, simple), parts).otherwise(whole)

        return F.flatten(F.transform(F.split(t, "\n", -1), of))

    return _by_spacing(text, units)


def rolling_hashes(text: Column) -> Column:
    """array<bigint>: at each of passage_units a hash of it and its neighbour; null where both are blank, and at the last.

    It is rolled over codes of the units: a hash of `same`, its last bit for blank units, the one before
    for those that begin a line.
    """

    def code(same: Column, blank: Column, begins) -> Column:
        return F.shiftleft(F.xxhash64(same), 2) + F.when(blank, 1).otherwise(0) + begins

    def codes_of(t: Column, simple: bool) -> Column:
        def of(line: Column) -> Column:
            parts = F.transform(F.transform(_pieces(line, simple), lambda p: _trimmed(p, simple)), lambda p, i: code(p, p == "", F.when(i == 0, 2).otherwise(0)))
            return F.when(_long(line, simple), parts).otherwise(F.array(code(line, _trimmed(line, simple) == "", F.lit(2))))

        return F.flatten(F.transform(F.split(t, "\n", -1), of))

    def rolled(codes: Column) -> Column:
        others = F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0)))
        either = lambda a, b: F.when(b.isNotNull() & (a.bitwiseAND(b).bitwiseAND(F.lit(1)) == 0), F.xxhash64(a.bitwiseAND(F.lit(-3)), b))
        return F.zip_with(codes, others, either)

    return let(_by_spacing(text, codes_of), rolled)


def _without(units: Column, places: Column) -> Column:
    """struct<text, chunks, lines>: the units without the passages that the pairs at these places make up."""

    def passages(gone: Column) -> Column:
        # Runs of consecutive places: where one begins, and where it ends.
        runs = F.zip_with(
            F.array_except(gone, F.transform(gone, lambda p: p + 1)), F.array_except(gone, F.transform(gone, lambda p: p - 1)),
            lambda start, end: F.struct(start.alias("start"), end.alias("end")),
        )
        line = lambda i: F.get(units, i)["line"]

        def counts(r: Column) -> Column:
            cut_before = F.coalesce(F.when(r["start"] > 0, line(r["start"] - 1)) == line(r["start"]), F.lit(False)).cast("int")
            cut_after = F.coalesce(line(r["end"] + 1) == line(r["end"]), F.lit(False)).cast("int")
            lines = line(r["end"]) - line(r["start"]) + 1 - cut_before - cut_after
            size = F.aggregate(F.slice(units, r["start"] + 1, r["end"] - r["start"] + 1), F.lit(0), lambda n, u: n + _n_words(u["same"]))
            return (lines > 1) | (size >= LONG_WORDS)

        return F.filter(runs, counts)

    def rebuilt(runs: Column) -> Column:
        dropped = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["end"])))
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(units) - 1), dropped), lambda p: F.get(units, p))

        def joined(k: Column) -> Column:
            new_line = lambda i: (i > 0) & (F.get(k, F.greatest(i - 1, F.lit(0)))["line"] != F.get(k, i)["line"])
            text = F.array_join(F.transform(k, lambda u, i: F.concat(F.when(new_line(i), "\n").otherwise(""), u["piece"])), "")
            lines = F.get(units, F.size(units) - 1)["line"] + 1 - F.size(F.array_distinct(F.transform(k, lambda u: u["line"])))
            return F.struct(text.alias("text"), F.size(runs).alias("chunks"), lines.alias("lines"))

        return let(kept, joined)

    both = F.array_sort(F.array_distinct(F.concat(places, F.transform(places, lambda p: p + 1))))
    return let(let(both, passages), rebuilt)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with text shortened by every repeated passage, and the ints removed_chunks and removed_lines.

    A passage is a run of two lines or more, not all blank, or of LONG_WORDS words or more inside lines,
    whose every two neighbouring units (see passage_units) stand as neighbours at an earlier place too:
    in a text of a smaller id, or further to the front. So each unit stays where it first stands. Two
    places that overlap, as in three equal lines, are one. A line alone is left unless it is that long.
    removed_chunks counts passages, removed_lines the lines that went whole. No row is dropped; rows
    without an id, equal rows, null texts and columns of the result's names are as in drop_repeated_chunks.

    Units are hashed once, and a rolling hash of two neighbours is taken at every place. Places whose
    rolling hash repeats are compared as bytes, by SHA-256. Both groupings count before they shuffle, and
    texts are shuffled twice, by document: to be compared, and to be rewritten.
    """
    lean = docs.select(F.col(id_col).alias("k"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t")).where("t is not null")

    lines = written(lean.select("k", "v", rolling_hashes(F.col("t")).alias("rolled")), "rolled-hashes")
    found = lines.select("k", "v", F.posexplode("rolled").alias("pos", "hash")).where("hash is not null")
    place = F.xxhash64("k", F.col("k").isNull(), "v", "pos")
    again = written(found.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("hash"), "repeats")
    suspects = found.join(again, "hash", "left_semi").groupBy("k", "v").agg(F.collect_list("pos").alias("places"))

    def pairs(units: Column) -> Column:
        def pair(p: Column) -> Column:
            a, b = F.get(units, p), F.get(units, p + 1)
            return F.struct(p.alias("pos"), F.unhex(F.sha2(F.concat(a["same"], F.when(a["line"] == b["line"], " ").otherwise("\n"), b["same"]), 256)).alias("same"))

        return F.transform("places", pair)

    later = _later(_at_places(lean, suspects, lambda t: let(passage_units(t), pairs)))
    overlapping = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("v") == F.col("first.v")) & (F.col("pos") == F.col("first.pos") + 1)
    drops = later.where(~overlapping).groupBy("k", "v").agg(F.collect_set("pos").alias("drops"))
    return _shortened(docs, drops, id_col, text_col, lambda t, places: let(passage_units(t), lambda u: _without(u, places)))
