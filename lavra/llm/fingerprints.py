"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range. Sketches of parts
merge into the sketch of the whole, and the share of a text contained in a much longer one can be
estimated from the two sketches alone. The fractions are nested halves: a text with few shingles keeps
a finer sketch, up to all of its hashes, and two sketches are compared at the coarser of their fractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.text import SHINGLE_WORDS, let, shingle_hashes
from lavra.sources.scratch import written

#: One hash in 2**SCALE_BITS is kept, of texts that have enough of them.
SCALE_BITS = 3
#: A sketch of fewer hashes is kept at the next finer fraction, down to all hashes.
LEAST_HASHES = 16


def _below(hashes: Column, bits: Column | int) -> Column:
    """The hashes whose leading `bits` bits are all zero; of 0 bits all of them."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    # Shifted in two steps: a shift by 64 would be one by 0.
    return F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", F.shiftrightunsigned(h, 1), F.lit(63) - bits) == 0)


def _coarsest(hashes: Column, bits: int, least: int) -> Column:
    """struct(bits, hashes) at the coarsest fraction, up to 2**-bits, that leaves `least` hashes; else with all hashes."""
    pair = lambda level, kept: F.struct(F.lit(level).alias("bits"), F.array_sort(kept).alias("hashes"))
    if bits == 0:
        return pair(0, F.array_distinct(hashes))
    return let(
        F.array_distinct(_below(hashes, bits)),
        lambda kept: F.when(F.size(kept) >= least, pair(bits, kept)).otherwise(_coarsest(hashes, bits - 1, least)),
    )


def sketch(text: Column, scale_bits: int = SCALE_BITS, size: int = SHINGLE_WORDS, least: int = LEAST_HASHES) -> Column:
    """struct(bits, hashes): the sorted distinct shingle hashes whose leading `bits` bits are all zero.

    bits is the largest number up to `scale_bits` that leaves at least `least` hashes, 0 (all hashes)
    where none does. Texts without words (null, empty, blank) have no hashes.
    """
    return let(shingle_hashes(text, size), lambda hashes: _coarsest(hashes, scale_bits, least))


def merge(a: Column, b: Column, scale_bits: int = SCALE_BITS, least: int = LEAST_HASHES) -> Column:
    """The sketch of two texts taken together (without the shingles across their seam).

    It equals the sketch of the union of their shingles: what either leaves out is out of the union's too.
    """
    level = F.greatest(a["bits"], b["bits"])
    both = let(level, lambda bits: _below(F.array_union(a["hashes"], b["hashes"]), bits))
    return let(
        F.struct(level.alias("bits"), both.alias("hashes")),
        lambda m: let(
            _coarsest(m["hashes"], scale_bits, least),
            lambda c: F.when(c["bits"] > m["bits"], c).otherwise(F.struct(m["bits"].alias("bits"), F.array_sort(m["hashes"]).alias("hashes"))),
        ),
    )


def _compared(a: Column, b: Column, measure) -> Column:
    """measure(hashes of a, hashes of b), both at the coarser of the two fractions."""
    at = let(
        F.greatest(a["bits"], b["bits"]),
        lambda bits: F.struct(_below(a["hashes"], bits).alias("a"), _below(b["hashes"], bits).alias("b")),
    )
    return let(at, lambda s: measure(s["a"], s["b"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; exact for two texts whose sketches hold all hashes.

    Two texts without words are alike (1).
    """

    def measure(x: Column, y: Column) -> Column:
        return let(
            F.size(F.array_intersect(x, y)),
            lambda s: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(s / (F.size(x) + F.size(y) - s)),
        )

    return _compared(a, b, measure)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the shingles of `part` that `whole` has too; exact where both hold all hashes.

    A part without words is contained (1). Null where `part` has no hash at the fraction of `whole`, so
    that the two sketches say nothing of it; `whole` sketched with fewer bits does.
    """

    def measure(x: Column, y: Column) -> Column:
        return F.when(F.size(part["hashes"]) == 0, F.lit(1.0)).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))

    return _compared(part, whole, measure)


def as_string(s: Column) -> Column:
    """The number of zero bits, a colon, and the hashes as fixed-width hexadecimal, space-separated."""
    return F.concat(s["bits"].cast("string"), F.lit(":"), F.array_join(F.transform(s["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " "))


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", scale_bits: int = SCALE_BITS) -> DataFrame:
    """docs with its sketch as a column struct<bits, hashes>; a column of that name is replaced.

    Null texts count as empty. Rows are never merged or dropped.
    """
    return docs.withColumn(out_col, sketch(F.col(text_col), scale_bits))


def next_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, next_id, n): for each distinct id the one that follows it, and its text's length.

    The last id is followed by the first. Ids are sorted over all partitions; each one's rank is its
    place in its partition plus the sizes of the partitions before, so no task sees more than its
    share. Null ids have no place and are left out; of rows that share an id the longest text counts.
    """
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("n")
    )
    placed = written(
        ids.orderBy("doc_id").select("doc_id", "n", F.monotonically_increasing_id().alias("m"))
        .select("doc_id", "n", F.shiftright("m", 33).alias("part"), (F.col("m").bitwiseAND((1 << 33) - 1)).alias("place")),
        "sorted-ids",
    )
    # One row per partition: bounded by the number of partitions, whatever the number of documents.
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(in_order), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    ranked = placed.join(F.broadcast(parts), "part").select("doc_id", "n", "total", (F.col("before") + F.col("place")).alias("rank"))
    follower = ranked.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("rank") - 1, F.col("total")).alias("rank"))
    return ranked.join(follower, "rank").select("doc_id", "next_id", "n")


def compare_edits(docs: DataFrame, scale_bits: int = SCALE_BITS) -> DataFrame:
    """Fingerprints every whole text and its edited text, and compares them.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the
    next document's text, by ascending doc_id; the last document is followed by the first. One row per
    input row. Null texts are empty. A row without an id has an empty follower. Rows that share an id
    have the same follower; as a follower they count as one, by the smallest text.
    Other columns of docs are not carried.
    """
    none = F.struct(F.lit(0).alias("bits"), F.array().cast("array<bigint>").alias("hashes"))
    sketched = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("fp", sketch(F.col("text"), scale_bits))
    # Dealt by id once: both joins below read this one exchange.
    own = sketched.where(F.col("doc_id").isNotNull()).repartition("doc_id")
    wanted = next_ids(docs).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), F.floor(F.col("n") / 4).cast("int").alias("most"))
    # Only what the edit takes travels to the document before: its head, and its fingerprint.
    sent = (
        own.join(wanted, "doc_id")
        .select("to_id", F.struct(F.expr("substring(text, 1, most)").alias("head"), F.col("fp").alias("fp")).alias("next"))
        .groupBy("to_id").agg(F.min("next").alias("next"))
    )
    followed = own.join(sent, own.doc_id == sent.to_id).select("doc_id", "text", "fp", F.col("next.head").alias("head"), F.col("next.fp").alias("next_fp"))
    alone = sketched.where(F.col("doc_id").isNull()).select("doc_id", "text", "fp", F.lit("").alias("head"), none.alias("next_fp"))
    joined = followed.unionByName(alone).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.expr("cast(n_chars div 4 as int)")
    edited = joined.withColumn("q", cut).select(
        "doc_id", "n_chars", "fp", "next_fp",
        F.expr("concat(substring(text, 1, cast(n_chars as int) - q), substring(head, 1, q))").alias("edited"),
    )
    both = edited.select("doc_id", "n_chars", "fp", "next_fp", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("edited"), scale_bits).alias("edited_fp"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
