"""Records of text files that cannot be told from a line alone, read by ranges in parallel.

Spark cuts files into ranges, and ranges into pieces at a separator. Whether a record ends at a separator
hangs on all that stands before it: on whether quotes are open, and on how deep brackets are nested. What a
range does to that is the same function whatever the range before did: from either state of the quotes, the
state after it and how much deeper it ends. So the ranges are summed up in parallel, the sums are put one
after another, and each range then begins with its true state. A record that crosses ranges is put
together from what each of them has of it; no file is ever held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.sources.scratch import written

#: Places of a file's records, at most, where places run through several files.
FILE_RECORDS = 1 << 40
#: (piece, whether quotes are open) to (whether they are open after it, by how much deeper it ends).
Scan = Callable[[bytes, bool], tuple[bool, int]]

_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)


def scan_csv(sep: str = ",") -> Scan:
    """Quotes open at the front of a field only, and are doubled inside."""
    comma = sep.encode()

    def scan(line: bytes, inside: bool) -> tuple[bool, int]:
        if b'"' not in line:
            return inside, 0
        at = 0
        while True:
            if not inside:
                if line[at : at + 1] == b'"':
                    inside, at = True, at + 1
                elif (at := line.find(comma, at)) < 0:
                    return False, 0
                else:
                    at += len(comma)
                continue
            if (at := line.find(b'"', at)) < 0:
                return True, 0
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside = False
            if (at := line.find(comma, at + 1)) < 0:
                return False, 0
            at += len(comma)

    return scan


_JSON_MARKS = re.compile(rb'\\.|["{}\[\]]', re.DOTALL).findall


def scan_json(piece: bytes, inside: bool) -> tuple[bool, int]:
    """Brackets count outside texts; a backslash takes the character behind it along."""
    deeper = 0
    for mark in _JSON_MARKS(piece):
        if mark == b'"':
            inside = not inside
        elif not inside:
            deeper += (mark in b"{[") - (mark in b"}]")
    return inside, deeper


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    read = spark.read.option("lineSep", sep).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def records(spark: SparkSession, path: str, sep: str, scan: Scan, depth: int = 0, encoding: str = "utf-8") -> DataFrame:
    """Rows (file, pos, place, text, last): what stands between separators at which quotes are closed and brackets `depth` deep.

    pos counts from 0 in each file, place too, and goes on from FILE_RECORDS in each next by name; `last` is whether it ends the file, and then `ended` whether quotes are
    closed and the depth is 0 there. Separators inside a record stay; a file of no bytes has no records. Any
    encoding will do that has the bytes of ASCII for ASCII and for nothing else. What Spark can't split, as
    gzip, is one range. Reads the files twice.
    """
    if "utf-16" in encoding.lower() or "utf-32" in encoding.lower():
        raise ValueError(f"ranges can't be told apart in {encoding}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, [[False, 0], [True, 0]]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "open0": states[0][0], "deep0": states[0][1], "open1": states[1][0], "deep1": states[1][1]}])

        for batch in batches:
            for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != key:
                    if key:
                        yield row()
                    key, states = (file, block), [[False, 0], [True, 0]]
                one, other = states
                was = one[0]
                one[0], deeper = scan(piece, was)
                one[1] += deeper
                # Once both states of the quotes have come together they stay so.
                other[0], again = (one[0], deeper) if other[0] == was else scan(piece, other[0])
                other[1] += again
        if key:
            yield row()

    pieces = _pieces(spark, path, sep)
    summed = pieces.mapInArrow(sums, "file string, block long, open0 boolean, deep0 long, open1 boolean, deep1 long")
    # A row for each range: of a file, so many as its size holds ranges. Put one after another in the JVM, as there may be many files.
    in_row = F.array_sort(F.collect_list(F.struct("block", "open0", "deep0", "open1", "deep1")))
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("deep"), F.array().cast("array<struct<block: bigint, inside: boolean, deep: bigint>>").alias("starts"))

    def after(state: Column, r: Column) -> Column:
        return F.struct(
            F.when(state["inside"], r["open1"]).otherwise(r["open0"]).alias("inside"), (state["deep"] + F.when(state["inside"], r["deep1"]).otherwise(r["deep0"])).alias("deep"),
            F.concat(state["starts"], F.array(F.struct(r["block"].alias("block"), state["inside"].alias("inside"), state["deep"].alias("deep")))).alias("starts"),
        )

    chained = summed.groupBy("file").agg(in_row.alias("in_row")).select("file", F.aggregate("in_row", zero, after).alias("end"))
    each = chained.select("file", F.inline("end.starts"), F.col("end")).select(
        "file", "block", "inside", "deep", (F.col("block") == F.element_at("end.starts", -1)["block"]).alias("final"), (~F.col("end.inside") & (F.col("end.deep") == 0)).alias("ended"),
    )
    begun = written(each, "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("raw", pa.binary()), ("final", pa.bool_()), ("ended", pa.bool_())])
        mark, key = sep.encode(), None
        held: list[bytes] = []
        inside, deep, n, found_any, started, rest = False, 0, 0, False, False, (False, False)

        def left() -> list[tuple]:
            if not held:
                return []
            return [(*key, n, _TAIL if started else _MIDDLE, mark.join(held), *rest)]

        for batch in batches:
            out = []
            for file, block, piece, was_inside, was_deep, final, ended in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != key:
                    out += left() if key else []
                    key, held, n, inside, deep, rest = (file, block), [], 0, was_inside, was_deep, (final, ended)
                    started = block == 0 or (not inside and deep == depth)
                inside, deeper = scan(piece, inside)
                deep += deeper
                held.append(piece)
                if not inside and deep == depth:
                    out.append((*key, n if started else -1, _WHOLE if started else _HEAD, mark.join(held), False, False))
                    n, held, started = n + started, [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kind.types)], schema=kind)
        if key and held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(left()[0], kind.types)], schema=kind)

    # Broadcast: some fifty bytes for each range of the text, whose rows must stay in their order.
    started = pieces.join(F.broadcast(begun), ["file", "block"]).select("file", "block", "piece", "inside", "deep", "final", "ended")
    parts = written(started.mapInArrow(cut, "file string, block long, n long, kind int, raw binary, final boolean, ended boolean"), "records")

    in_order = Window.partitionBy("file").orderBy("block", "kind")
    # Two rows for each range at most.
    torn = parts.where(F.col("kind") != _WHOLE).withColumn("k", F.sum((F.col("kind") == _TAIL).cast("long")).over(in_order))
    bytes_of = F.array_sort(F.collect_list(F.struct("block", "kind", "raw")))["raw"]
    # Concatenated with separators in between, as bytes.
    joined = F.aggregate(bytes_of, F.unhex(F.lit("")), lambda a, x: F.when(F.octet_length(a) == 0, x).otherwise(F.concat(a, F.lit(sep).cast("binary"), x)))
    mended = torn.groupBy("file", "k").agg(
        F.min(F.struct("block", "kind", "n")).alias("at"), joined.alias("raw"), F.bool_or("final").alias("final"), F.bool_or("ended").alias("ended"),
    ).select("file", "at.block", "at.n", "raw", "final", "ended")
    every = parts.where(F.col("kind") == _WHOLE).select("file", "block", "n", "raw", "final", "ended").unionByName(mended)

    begins = parts.where(F.col("kind").isin(_WHOLE, _TAIL)).groupBy("file", "block").agg(F.count(F.lit(1)).alias("records"))
    # A row for each range here too.
    nth = F.dense_rank().over(Window.orderBy("file")) - 1
    before = begins.select("file", "block", (nth.cast("long") * FILE_RECORDS).alias("from"), (F.sum("records").over(Window.partitionBy("file").orderBy("block")) - F.col("records")).alias("before"))
    placed = every.join(F.broadcast(before), ["file", "block"]).select("file", (F.col("before") + F.col("n")).alias("pos"), (F.col("from") + F.col("before") + F.col("n")).alias("place"), "raw", F.col("final").alias("last"), "ended")
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return placed.select("file", "pos", "place", F.col("raw").cast("string").alias("text"), "last", "ended")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([r.decode(encoding, "replace") for r in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts, *batch.columns[4:]], names=["file", "pos", "place", "text", "last", "ended"])

    return placed.mapInArrow(decoded, "file string, pos long, place long, text string, last boolean, ended boolean")
