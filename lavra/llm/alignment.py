"""Alignment of two tokenizers over a corpus, with counts of the pairs that they link.

Tokens of both sides are laid over the same bytes. Where both end, a group ends; tokens that overlap are
linked. How many documents hold a pair linked is counted by external spill counting: pair-document records
are dealt by the radix of their left id and leave the tokenizing tasks as sorted, zstd-compressed runs; a
task merges the runs of a radix by a heap, left id by left id, so that it has the counts of all pairs of
an id, and with them its highest, before it streams the contributions of that id back to the documents.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.llm.bpe import Memo
from lavra.sources.scratch import written

#: Stretches of text, and pre-tokens, that a worker remembers.
MEMO_UNITS = 300_000
#: Code points handled at once.
SEGMENT = 1_000_000
#: Records that a task gathers before it writes a run for each radix.
RUN_RECORDS = 2_000_000
#: Left ids are dealt by their remainder.
RADIX = 512
#: Records merged by one task; a radix with more is merged in parts.
MERGE_RECORDS = 16_000_000
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>").fullmatch

COUNTS = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]


class Aligner:
    """Tokens of the left (byte-level BPE of the tokenizers library) and right tokenizer (SentencePiece), aligned.

    A text falls into units: each begins with a single blank or line feed between two characters that
    are no white space. Neither tokenizer joins anything across such a place, as the left splits there and
    no piece of the right holds a blank behind another character, nor a line feed. So a unit is aligned
    once and remembered.
    """

    def __init__(self, left_json: str, right_model: bytes):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_str(left_json)
        self.right = sentencepiece.SentencePieceProcessor(model_proto=right_model)
        # Byte-level vocabularies show each byte as a printable character: itself, or one from U+0100 on.
        itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = (b for b in range(256) if b not in itself)
        self.shown = {b: chr(b) for b in itself} | {b: chr(256 + k) for k, b in enumerate(others)}
        raw = {mark: byte for byte, mark in self.shown.items()}
        vocabulary = self.left.get_vocab()
        self.n_left, self.n_right = max(vocabulary.values()) + 1, self.right.get_piece_size()
        if self.n_left * self.n_right > 1 << 32:
            raise ValueError("pairs of ids must fit into 32 bits")
        self.left_bytes = [b""] * self.n_left
        for token, i in vocabulary.items():
            self.left_bytes[i] = bytes(raw[c] for c in token) if all(c in raw for c in token) else token.encode()
        self.right_bytes = [self._piece(self.right.id_to_piece(i)) for i in range(self.n_right)]
        self.left_sizes, self.right_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.left_bytes, self.right_bytes))
        # Each id with the mark behind it: inside its side of a group, and at the end of that side.
        self.marked = [b"%d%s" % (i, m) for n, marks in ((self.n_left, (b",", b"|")), (self.n_right, (b",", b";"))) for i in range(n) for m in marks]
        self.blank = self.right.piece_to_id(_SPACE)
        self.merge = self.left.model.tokenize
        # The pre-tokens of the left tokenizer, in the classes of the regex library.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.other_blank = re.compile(r"[^\S \n]").search
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\S)").split
        self.units, self.parts = Memo(MEMO_UNITS), Memo(MEMO_UNITS)

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode()

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part) or self.parts.old.get(part)
        if ids is None:
            ids = [t.id for t in self.merge("".join(map(self.shown.__getitem__, part.encode())))]
        if len(part) < 100:
            self.parts[part] = ids
        return ids

    def left_ids(self, text: str) -> list[int]:
        if text[:1] == " " and text[1:-1].isalpha():
            # Letters, and one more character at most, whose place the splitter leaves no choice about.
            if text[-1].isalpha():
                return self._part(text)
            if text[-1] in ".,;:!?)":
                return self._part(text[:-1]) + self._part(text[-1])
        return [i for part in self.split(text) for i in self._part(part)]

    def align(self, raws: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[tuple[bytes, int, int, int, bytes] | None]:
        """For each unit: groups as text, each with a semicolon behind it, n_a, n_b, n_groups, and links.

        Links are left * n_right + right in four bytes. None stands for units whose bytes differ.
        """
        flat_a, flat_b = [i for ids in a for i in ids], [i for ids in b for i in ids]
        whole = b"".join(raws)
        if b"".join(map(self.left_bytes.__getitem__, flat_a)) != whole or b"".join(map(self.right_bytes.__getitem__, flat_b)) != whole:
            if len(raws) > 1:
                half = len(raws) // 2
                return self.align(raws[:half], a[:half], b[:half]) + self.align(raws[half:], a[half:], b[half:])
            return [None]
        sides = []
        for flat, sizes in ((flat_a, self.left_sizes), (flat_b, self.right_sizes)):
            ids = np.array(flat, np.int64)
            sides.append((ids, np.cumsum(sizes[ids])))
        (ids_a, ends_a), (ids_b, ends_b) = sides
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        # Between two neighbouring ends lies one token of each side: a link.
        ends = np.union1d(ends_a, ends_b)
        links = (ids_a[np.searchsorted(ends_a, ends)] * self.n_right + ids_b[np.searchsorted(ends_b, ends)]).astype("<u4").tobytes()
        # Tokens in the order of the groups' text; each brings the mark that stands behind it.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        shown = list(map(self.marked.__getitem__, np.r_[2 * ids_a + last_a, 2 * (self.n_left + ids_b) + last_b][order].tolist()))
        bounds = np.cumsum([len(r) for r in raws])
        at = lambda places: np.r_[0, np.searchsorted(places, bounds, side="right")]
        n_a, n_b, n_groups, n_links = at(ends_a), at(ends_b), at(common), (4 * at(ends)).tolist()
        n_tokens = (n_a + n_b).tolist()
        return [
            (b"".join(shown[n_tokens[k] : n_tokens[k + 1]]), x, y, z, links[n_links[k] : n_links[k + 1]])
            for k, (x, y, z) in enumerate(zip(np.diff(n_a).tolist(), np.diff(n_b).tolist(), np.diff(n_groups).tolist()))
        ]

    def learn(self, units: set[str]) -> None:
        """Makes sure that all units are known. A unit without white space before it stands for one after a blank."""
        self.units.turn()
        self.parts.turn()
        old, rest = self.units.old, []
        for u in units:
            if u in self.units:
                continue
            if u in old:
                self.units[u] = old[u]
            else:
                rest.append(u)
        if not rest:
            return
        # The right tokenizer puts a blank before everything: it stays before words and goes before line feeds.
        right = self.right.encode([u[1:] if u[0] == " " else u for u in rest], num_threads=1)
        keys = []
        for k, u in enumerate(rest):
            if u[0] == "\n":
                if right[k][:1] != [self.blank]:
                    raise ValueError("the right tokenizer joins a blank with a line feed")
                right[k] = right[k][1:]
            keys.append(u if u[0] in " \n" else " " + u)
        self.units.update(zip(rest, self.align([k.encode() for k in keys], list(map(self.left_ids, keys)), right)))

    def units_of(self, text: str) -> list[str]:
        units = text.replace("\n", " \n").split(" ")
        if all(units) and "\n" not in units and not self.other_blank(text):
            return units
        first, *rest = self.cut(" " + text)
        plain = lambda u: u[1:] if u[0] == " " and not u[1:2].isspace() and len(u) > 1 else u
        return [plain(first), *map(plain, rest)]

    def texts(self, texts: list[str]) -> Iterator[list[tuple] | None]:
        """The units of each text, aligned; None where a text has no tokens. A unit too long to be remembered is given too."""
        at = 0
        while at < len(texts):
            size, few = 0, []
            while at < len(texts) and (not few or size < SEGMENT):
                few.append(self.units_of(texts[at]) if texts[at] else [])
                size += len(texts[at])
                at += 1
            self.learn({u for us in few for u in us})
            for us in few:
                known = list(map(self.units.__getitem__, us))
                yield known if known and None not in known else None


@functools.lru_cache(1)
def _aligner(left_json: str, right_model: bytes) -> Aligner:
    """One for each worker process, whatever the number of its tasks."""
    return Aligner(left_json, right_model)


def pack_run(codes: np.ndarray, rows: np.ndarray, times: np.ndarray) -> bytes:
    """Records (code, row, times) sorted by code and row, as one compressed run."""
    import zstandard

    new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    least = int(rows.min())
    narrow = lambda x: x.astype(next(t for t in ("u1", "<u2", "<u4", "<u8") if int(x.max()) <= np.iinfo(t).max))
    parts = [codes[new].astype("<u4"), np.diff(np.r_[new, len(codes)]).astype("<u4"), narrow(rows - least), narrow(times)]
    head = np.array([least, len(new), len(codes), parts[2].itemsize, parts[3].itemsize], "<u8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(p.tobytes() for p in parts)]))


def open_run(run: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """(codes, records of each code, least row, rows less that, times) of a run."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(run)
    least, pairs, records, wide, deep = np.frombuffer(raw, "<u8", 5).tolist()
    codes, sizes = np.frombuffer(raw, "<u4", 2 * pairs, 40).reshape(2, pairs)
    at = 40 + 8 * pairs
    return codes, sizes, least, np.frombuffer(raw, f"<u{wide}", records, at), np.frombuffer(raw, f"<u{deep}", records, at + wide * records)


def aligned(docs: DataFrame, left_json: str, right_model: bytes, run_records: int = RUN_RECORDS, radix: int = RADIX, with_groups: bool = False) -> DataFrame:
    """A row for each row of docs (id, text), and rows that hold runs of records.

    Documents: row (a number of its own), id, n_a, n_b, n_groups, n_links, groups_sha256 (and groups, where
    asked for). Runs: radix, records, run. Write the result before it is used: row numbers may be others when
    it is computed again.
    """
    shared = docs.sparkSession.sparkContext.broadcast((left_json, right_model))  # two vocabulary files: their size is fixed
    fields = [T.StructField("row", T.LongType()), docs.schema["id"], *COUNTS, T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField("groups", T.StringType())] * with_groups
    fields += [T.StructField("radix", T.IntegerType()), T.StructField("records", T.LongType()), T.StructField("run", T.BinaryType())]
    schema = T.StructType(fields)
    n_doc = len(fields) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, kind, held, gathered = _aligner(*shared.value), None, [], 0

        def runs() -> Iterator[pa.RecordBatch]:
            codes, rows, times = (np.concatenate(x) for x in zip(*held))
            digit = codes // aligner.n_right % radix
            order = np.argsort(digit << 32 | codes, kind="stable")
            digit, codes, rows, times = digit[order], codes[order], rows[order], times[order]
            found, ends = np.unique(digit, return_index=True)
            ends = [*ends.tolist(), len(digit)]
            packed = [pack_run(codes[lo:hi], rows[lo:hi], times[lo:hi]) for lo, hi in zip(ends, ends[1:])]
            nothing = [pa.nulls(len(found), kind.field(i).type) for i in range(n_doc)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(found, pa.int32()), pa.array(np.diff(ends)), pa.array(packed, pa.binary())], names=schema.names)

        for batch in batches:
            if kind is None:
                kind = pa.schema([("row", pa.int64()), ("id", batch.column(1).type), *((f.name, pa.int64()) for f in COUNTS), *((n, pa.string()) for n in schema.names[6:n_doc])])
            texts = batch.column(2).to_pylist()
            counts, shas, groups = [], [], []
            part, owners, first = [], [], 0
            numbers = batch.column(0).to_numpy()

            def records() -> int:
                """Links of the texts since the last call, as distinct pairs of each row with their times, by row."""
                if not part:
                    return 0
                lengths = np.array([len(p) // 4 for p in part])
                code = np.frombuffer(b"".join(part), "<u4").astype(np.int64)
                key, times = np.unique(np.repeat(np.arange(len(part)), lengths) << 32 | code, return_counts=True)
                held.append((key & 0xFFFFFFFF, numbers[owners][key >> 32], times))
                part.clear()
                owners.clear()
                return len(key)

            size = 0
            for i, units in enumerate(aligner.texts([t or "" for t in texts])):
                if units is None:
                    counts.append((0, 0, 0, 0))
                    shas.append("")
                    groups.append("")
                    continue
                g, a, b, n, links = zip(*units)
                g, links = b"".join(g)[:-1], b"".join(links)
                counts.append((sum(a), sum(b), sum(n), len(links) // 4))
                shas.append(hashlib.sha256(g).hexdigest())
                if with_groups:
                    groups.append(g.decode())
                part.append(links)
                owners.append(i)
                size += len(links)
                if size > 4_000_000:
                    gathered += records()
                    size = 0
                if gathered >= run_records:
                    yield from runs()
                    held, gathered = [], 0
            gathered += records()
            n = len(texts)
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (zip(*counts) if counts else [()] * 4)), pa.array(shas, pa.string())]
            columns += [pa.array(groups, pa.string())] * with_groups
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=schema.names)
        if held:
            yield from runs()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return numbered.mapInArrow(run, schema)


def merge_runs(runs: list[bytes], n_right: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple]]]:
    """(left id, its right ids in order, their counts, parts) by left id: a k-way merge of the runs by a heap.

    A part is (run, which of the right ids each record has, records from, to).
    """
    opened = [open_run(r) for r in runs]
    places, heap = [], []
    for k, (codes, sizes, *_) in enumerate(opened):
        left = codes // n_right
        starts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        places.append((left[starts].tolist(), [*starts.tolist(), len(codes)], np.r_[0, np.cumsum(sizes, dtype=np.int64)]))
        heap.append((places[-1][0][0], k, 0))
    heapq.heapify(heap)
    while heap:
        a, parts = heap[0][0], []
        while heap and heap[0][0] == a:
            _, k, at = heap[0]
            ids, starts, before = places[k]
            parts.append((k, starts[at], starts[at + 1]))
            if at + 1 < len(ids):
                heapq.heapreplace(heap, (ids[at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        right, where = np.unique(np.concatenate([opened[k][0][lo:hi] for k, lo, hi in parts]) % n_right, return_inverse=True)
        sizes = [opened[k][1][lo:hi] for k, lo, hi in parts]
        counts = np.bincount(where, np.concatenate(sizes), len(right)).astype(np.int64)
        done, spans = 0, []
        for (k, lo, hi), n in zip(parts, sizes):
            spans.append((k, np.repeat(where[done : done + len(n)], n), int(places[k][2][lo]), int(places[k][2][hi])))
            done += len(n)
        yield a, right, counts, spans


class _Back:
    """Sums of counts, and links at the highest count, for the rows of each run."""

    def __init__(self, runs: list[bytes]):
        self.opened = [open_run(r)[2:] for r in runs]
        self.sums = [[np.zeros(int(rows.max()) + 1, np.int64) for _ in range(2)] for _, rows, _ in self.opened]

    def add(self, counts: np.ndarray, highest: int, spans: list[tuple]) -> None:
        for k, where, lo, hi in spans:
            _, rows, times = self.opened[k]
            total, best = self.sums[k]
            count, times, rows = counts[where], times[lo:hi].astype(np.int64), rows[lo:hi].astype(np.intp)
            np.add.at(total, rows, count * times)
            top = count == highest
            np.add.at(best, rows[top], times[top])

    def table(self) -> pa.Table:
        found = []
        for (least, _, _), (total, best) in zip(self.opened, self.sums):
            there = np.flatnonzero(total)
            found.append((there + least, total[there], best[there]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names=["row", "count_sum", "n_best"])


def pair_links(runs: DataFrame, n_right: int, merge_records: int = MERGE_RECORDS) -> DataFrame:
    """Rows (row, count_sum, n_best), one for each row with links, from written runs (radix, records, run).

    A pair's count is how many rows hold it; count_sum adds up the counts of a row's links, n_best counts
    those whose count is the highest of their left id. Runs of a radix with more than merge_records records,
    as very common left ids have in large corpora, are dealt into parts: their counts are added up in one
    more step, and go back to every part. Either way gives the same rows.
    """
    sizes = written(runs.groupBy("radix").agg(F.ceil(F.sum("records") / merge_records).alias("parts")), "radixes")
    # One row for each radix: bounded by `radix`, whatever the corpus.
    dealt = runs.join(F.broadcast(sizes), "radix").select("radix", "parts", F.pmod(F.xxhash64("run"), "parts").alias("part"), "run")

    def whole(table: pa.Table) -> pa.Table:
        blobs = table.column("run").to_pylist()
        back = _Back(blobs)
        for _, _, counts, spans in merge_runs(blobs, n_right):
            back.add(counts, int(counts.max()), spans)
        return back.table()

    kind = "row long, count_sum long, n_best long"
    found = dealt.where("parts = 1").groupBy("radix").applyInArrow(whole, kind)
    if not sizes.where("parts > 1").isEmpty():
        found = found.unionByName(_in_parts(dealt.where("parts > 1"), sizes, n_right, kind))
    return found.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def _in_parts(dealt: DataFrame, sizes: DataFrame, n_right: int, kind: str) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        found = [(np.full(len(right), a), right, counts) for a, right, counts, _ in merge_runs(table.column("run").to_pylist(), n_right)]
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
        return pa.table([table.column("radix").slice(0, 1).take(pa.array(np.zeros(len(columns[0]), np.int64))), *columns], names=["radix", "a", "b", "n"])

    counted = dealt.groupBy("radix", "part").applyInArrow(count, "radix int, a long, b long, n long")
    totals = written(counted.groupBy("radix", "a", "b").agg(F.sum("n").alias("n")), "pair-counts")

    def back(table: pa.Table, totals: pa.Table) -> pa.Table:
        blobs = table.column("run").to_pylist()
        out = _Back(blobs)
        a, b, n = (totals.column(c).to_numpy() for c in ("a", "b", "n"))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        for left, right, _, spans in merge_runs(blobs, n_right):
            lo, hi = np.searchsorted(a, [left, left + 1])
            out.add(n[lo:hi][np.searchsorted(b[lo:hi], right)], int(n[lo:hi].max()), spans)
        return out.table()

    each = totals.join(F.broadcast(sizes), "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).cast("long").alias("part"), "a", "b", "n")
    return dealt.groupBy("radix", "part").cogroup(each.groupBy("radix", "part")).applyInArrow(back, kind)


def align_documents(docs: DataFrame, left_json: str, right_model: bytes, id_col: str = "doc_id", text_col: str = "text", run_records: int = RUN_RECORDS, radix: int = RADIX, merge_records: int = MERGE_RECORDS, with_groups: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    The left tokenizer gets a blank and the text, the right the text, before which it puts a blank itself;
    special tokens are plain text. A text that is null or empty, or whose tokens don't give its bytes back
    (one with U+2581 in it), has no tokens: zeros and empty strings. Rows that repeat count as often as they
    occur. Other columns, whatever their names, are not carried. Groups are `a1,a2|b1;a3|b2,b3`.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    n_right = sentencepiece.SentencePieceProcessor(model_proto=right_model).get_piece_size()
    if max(Tokenizer.from_str(left_json).get_vocab().values()) * n_right >= 1 << 32:
        raise ValueError("pairs of ids must fit into 32 bits")
    both = written(aligned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), left_json, right_model, run_records, radix, with_groups), "aligned")
    links = pair_links(both.where("radix is not null").select("radix", "records", "run"), n_right, merge_records)
    rows = both.where("radix is null").drop("radix", "records", "run").withColumnRenamed("row", "__row")
    joined = rows.join(links, F.col("__row") == F.col("row"), "left")
    more = ["groups"] if with_groups else []
    return joined.select(F.col("id").alias(id_col), *(f.name for f in COUNTS), F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", *more)
