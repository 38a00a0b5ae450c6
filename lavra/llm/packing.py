"""Best-fit packing of tokenised documents into sequences: best-two-fit.

A sequence is filled greedily, always with the longest piece that still fits. Then its smallest piece
is exchanged for two unpacked pieces where two exist that fill the widened gap more tightly.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.sources.scratch import written

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together. The loss against packing all at once is at most one part-filled
#: sequence or so per block, whatever the size of the corpus.
BLOCK_PIECES = 65_536
#: Distinct words whose ids a worker remembers.
MEMO_WORDS = 250_000
#: Code points handled at once.
SEGMENT = 1_000_000
_LOW = re.compile("[\0-\u024f]*").fullmatch

PIECE_FIELDS = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins what a blank or a line feed separates.

    Each distinct word is encoded once and remembered, and so is each distinct run of letters, which many
    words share once they are lower-cased and rid of marks; so the tokenizer sees a small part of a
    corpus. Words of letters and marks below U+0250 go to the tokenizer's merges directly, as its
    normaliser and splitter would only lower-case and split them; any other word takes its whole way.
    """

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize  # looked up once: each look costs more than a word
        spec = json.loads(tokenizer_json)
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        self.added = [t["content"] for t in spec["added_tokens"]]
        # The printable stand-in of each byte, as the byte-level step has it.
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.stand_in = {b: by_byte.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)}
        for lead in range(0x80, 0x250, 0x40):
            c = chr(lead)
            for byte, mark in zip(c.encode(), by_byte.pre_tokenize_str(c)[0][0]):
                self.stand_in[byte] = mark
        for c in map(chr, range(0x80, 0xC0)):
            self.stand_in[c.encode()[1]] = by_byte.pre_tokenize_str(c)[0][0][1]
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of what the tokenizer's splitter leaves whole, lower-cased and below U+0250."""
        found = self.parts.get(part)
        if found is None:
            found = self.old_parts.get(part)
            if found is None:
                shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.stand_in)
                # Four bytes an id on every platform that Spark runs on.
                found = array("I", [t.id for t in self.merge(shown)]).tobytes()
            self.parts[part] = found
        return found

    def _direct(self, word: str) -> bytes | None:
        # Below U+0250 every text is in composed form already. A dotted capital I leaves a mark above it.
        lower = word.lower()
        if not _LOW(lower):
            return None
        if lower.isalpha():
            return self._part(lower)
        head, mark = lower[:-1], lower[-1]
        if head.isalpha() and "!" <= mark <= "~":
            return self._part(head) + self._part(mark)
        if not word.isprintable() or any(a in word for a in self.added):
            return None
        return b"".join(map(self._part, self.split(lower)))

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Makes sure that all words are known; the least lately used are forgotten."""
        if len(self.young) > MEMO_WORDS:
            self.young, self.old = {"": b""}, self.young
        if len(self.parts) > MEMO_WORDS:
            self.parts, self.old_parts = {}, self.parts
        young, old, direct, rest = self.young, self.old, self._direct, []
        for word in words.difference(young):
            found = old.get(word)
            if found is None:
                found = direct(word)
            if found is None:
                rest.append(word)
            else:
                young[word] = found
        for word, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            young[word] = np.array(e.ids, dtype="<u4").tobytes()
        return young

    def segments(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + SEGMENT)
            end = len(text) if end < 0 else end
            yield text[at:end].replace("\n", " ").split(" ")
            at = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for few in _by_size(texts):
            split = [list(self.segments(t)) for t in few]
            known = self.learn(set().union(*(seg for segs in split for seg in segs))).__getitem__
            for segs in split:
                yield b"".join(b"".join(map(known, seg)) for seg in segs)


def _by_size(texts: list[str]) -> Iterator[list[str]]:
    few, size = [], 0
    for t in texts:
        few.append(t)
        size += len(t)
        if size >= SEGMENT:
            yield few
            few, size = [], 0
    yield few


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32 (and ids, where asked for).

    A document is its ids and then END_ID. Only documents longer than `capacity` are cut, into pieces
    of `capacity` ids; the last may be shorter. A null or empty text is a document of one id. Rows
    that repeat are packed as often as they occur. Other columns are not carried.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *PIECE_FIELDS]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file: its size is fixed

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or WordEncoder(source.value)
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, found in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                all_ids = found + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(pieces, T.StructType(fields))


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; all lengths lie in 1..capacity."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    stacks = {int(v): list(order[lo:hi]) for v, lo, hi in _runs(lengths[order])}
    there = sorted(stacks)
    present = counts > 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(v: int) -> int:
        item = stacks[v].pop()
        if not stacks[v]:
            del there[bisect.bisect_left(there, v)]
            present[v] = False
        return item

    def put_back(v: int, item: int) -> None:
        if not stacks[v]:
            bisect.insort(there, v)
            present[v] = True
        stacks[v].append(item)

    k = 0
    while there:
        gap, chosen = capacity, []
        while (p := bisect.bisect_right(there, gap)) and gap:
            v = there[p - 1]
            chosen.append((take(v), v))
            gap -= v
        item, smallest = chosen[-1]
        if gap and (pair := _pair(present, stacks, smallest, smallest + gap)):
            chosen.pop()
            put_back(smallest, item)
            chosen += [(take(v), v) for v in pair]
        at = 0
        for item, v in chosen:
            bins[item], offsets[item] = k, at
            at += v
        k += 1
    return bins, offsets


def _runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    values, starts = np.unique(ordered, return_index=True)
    yield from zip(values, starts, [*starts[1:], len(ordered)])


def _pair(present: np.ndarray, stacks: dict[int, list], over: int, most: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (over, most]."""
    for total in range(most, over, -1):
        half = total // 2
        small = np.flatnonzero(present[1 : half + 1] & present[total - 1 : total - half - 1 : -1]) + 1
        for a in small[::-1]:
            if 2 * a != total or len(stacks[int(a)]) > 1:
                return total - int(a), int(a)
    return None


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: each sequence holds at most `capacity` ids, without gaps.

    Pieces are dealt by hash into blocks of about `block_pieces` rows, as many blocks as the corpus
    needs, and each block is packed by one task, in the order of its columns: the rows of `pieces` may come in
    any order. Rows equal in all columns go to one block, some forty bytes each. Needs the columns of token_pieces, with lengths in
    1..capacity. `pieces` should be a written table: it is counted first.
    """
    blocks = max(1, -(-pieces.count() // block_pieces))
    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    names = [c for c in pieces.columns]

    def fill(key: tuple, block: pa.Table) -> pa.Table:
        # In one order however the rows arrive: a block that is computed again gives the same places.
        block = block.sort_by([(c, "ascending") for c in names if not pa.types.is_nested(block.schema.field(c).type)])
        lengths = block.column("length").to_numpy()
        bins, offsets = best_two_fit(lengths, capacity)
        sequence = bins + (key[0].as_py() << 32)
        return pa.table([*(block.column(c) for c in names), pa.array(sequence), pa.array(offsets)], names=[f.name for f in fields])

    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64(*names), F.lit(blocks)))
    return dealt.groupBy("__block").applyInArrow(fill, T.StructType(fields))


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces and pack. The pieces (some forty bytes each) are written once, so no text is tokenised twice."""
    return pack(written(token_pieces(docs, tokenizer_json, capacity), "pieces"), capacity)


def sequences(packed: DataFrame, pieces_with_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence: sequence_id, length, input_ids and the ids of its documents in order.

    A group holds at most one sequence's ids. Repeated (id, piece) pairs are told apart by their ids.
    """
    where = packed.dropDuplicates([id_col, "piece", "ids_crc32", "sequence_id", "offset"]).select(
        F.col(id_col).alias("id"), "piece", "ids_crc32", "sequence_id", "offset"
    )
    ids = pieces_with_ids.dropDuplicates([id_col, "piece", "ids_crc32"]).select(
        F.col(id_col).alias("i_id"), F.col("piece").alias("i_piece"), F.col("ids_crc32").alias("i_crc32"), "ids"
    )
    same = F.col("id").eqNullSafe(F.col("i_id")) & (F.col("piece") == F.col("i_piece")) & (F.col("ids_crc32") == F.col("i_crc32"))
    parts = where.join(ids, same).select("sequence_id", F.struct("offset", "id", "ids").alias("part"))
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return ordered.select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("input_ids"),
        F.col("parts.id").alias("documents"),
    ).withColumn("length", F.size("input_ids").cast("long"))
