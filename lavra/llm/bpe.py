"""Byte-level BPE: encoding and decoding by a rank file.

Two tiers: a minimal perfect hash resolves pre-tokens that are in the vocabulary as they stand; the
others are merged by a heap over linked bytes. Results are remembered per word, in bounded memory.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words, and pre-tokens, whose ids a worker remembers.
MEMO_WORDS = 400_000
#: Code points handled at once.
SEGMENT = 1_000_000

_MIX = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order; ranks must run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


class PerfectHash:
    """Minimal perfect hash of byte strings to their positions, by hash, bucket and pilot.

    Keys are dealt into small buckets; each bucket, largest first, gets the first pilot that sends all
    its keys to free slots. A look-up compares the stored key, so strangers are told apart.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        hashes = np.array([self.digest(k) for k in keys], dtype=np.uint64)
        dealt = hashes % np.uint64(self.buckets)
        order = np.argsort(dealt, kind="stable")
        bounds = np.searchsorted(dealt[order], np.arange(self.buckets + 1))
        taken = np.zeros(self.n, dtype=bool)
        owner = np.zeros(self.n, dtype=np.int64)
        self.pilots = [0] * self.buckets
        tries = (np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX))[:, None]
        for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):
            inside = order[bounds[b] : bounds[b + 1]]
            if not len(inside):
                break
            step = 0
            while True:
                pilots = tries + np.uint64(step * 256 * _MIX & _FULL)
                slots = self._slots(hashes[inside][None, :] ^ pilots)
                good = ~taken[slots].any(axis=1)
                if len(inside) > 1:
                    good &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if good.any():
                    first = int(np.argmax(good))
                    break
                step += 1
            taken[slots[first]] = True
            owner[slots[first]] = inside
            self.pilots[b] = int(pilots[first, 0])
        self.keys = [keys[i] for i in owner]
        self.values = owner.tolist()

    def _slots(self, mixed: np.ndarray) -> np.ndarray:
        x = mixed * np.uint64(_MIX)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int | None:
        h = self.digest(key)
        x = (h ^ self.pilots[h % self.buckets]) * _MIX & _FULL
        slot = (x ^ x >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges neighbours, lowest rank first and leftmost on ties, until none has a rank.

    Parts are linked by their ends and by the starts before them. The heap holds candidate merges as
    rank and start in one integer; a candidate whose rank is no longer that of the pair which starts
    there is skipped. O(n log n) in the bytes of the piece.
    """
    n = len(piece)
    rank_of = ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    end = list(range(1, n + 2))  # of the part that starts here
    before = list(range(-1, n))  # start of the part before the one that starts here
    due = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts here
    due += (-1, -1)
    heap = [r << shift | i for i, r in enumerate(due) if r >= 0]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & mask
        if due[i] != entry >> shift:
            continue
        j = end[i]
        stop = end[i] = end[j]
        due[j] = -1
        if stop < n:
            before[stop] = i
            r = due[i] = rank_of(piece[i : end[stop]], -1)
            if r >= 0:
                heappush(heap, r << shift | i)
        else:
            due[i] = -1
        p = before[i]
        if p >= 0:
            r = due[p] = rank_of(piece[p:stop], -1)
            if r >= 0:
                heappush(heap, r << shift | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Memo(dict):
    """A dict of bounded size: what was not asked for in the last generation is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str):
        import regex

        self.tokens, self.table = tokens, table
        self.split = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pieces, self.words = Memo(MEMO_WORDS), Memo(MEMO_WORDS)

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        raw = text.encode("utf-8", "replace")
        whole = self.table.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        found = self.pieces.get(text) or self.pieces.old.get(text)
        if found is None:
            found = array("I", merge_bytes(raw, self.ranks)).tobytes()
        if len(raw) < 200:
            self.pieces[text] = found
        return found

    def slowly(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def learn(self, words: set[str]) -> None:
        """Makes sure that every word's ids, after a blank, are known; None where a word does not stand alone."""
        self.words.turn()
        self.pieces.turn()
        old = self.words.old
        for w in words.difference(self.words):
            found = old.get(w)
            if found is None and w and not w[0].isspace() and not w[-1].isspace():
                found = self.slowly(" " + w)
            self.words[w] = found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text.

        A single blank between two characters that are no white space always begins a pre-token, so a
        text of such words is encoded word by word. Other texts are split as a whole.
        """
        for few in _by_size(texts):
            split = [t.split(" ") for t in few]
            self.learn({w for ws in split for w in ws[1:]})
            for text, ws in zip(few, split):
                try:
                    if ws[0][-1:].isspace() or not ws[0]:
                        raise TypeError
                    yield self.slowly(ws[0]) + b"".join(map(self.words.__getitem__, ws[1:]))
                except TypeError:  # a word that does not stand alone
                    yield self.slowly(text)


def _by_size(texts: list[str]) -> Iterator[list[str]]:
    few, size = [], 0
    for t in texts:
        few.append(t)
        size += len(t)
        if size >= SEGMENT:
            yield few
            few, size = [], 0
    yield few


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>), one per row of docs; each match of `pattern` is encoded separately.

    Null and empty texts have no ids. Special tokens are ordinary text. Other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))  # as large as the vocabulary
    fields = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(*shared.value, pattern)
            found = list(encoder.encode([t or "" for t in batch.column(1).to_pylist()]))
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, fields)


def decode_ids(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, tokens: list[bytes], id_col: str = "doc_id") -> DataFrame:
    """Rows (id, ids, bytes): the bytes that the ids stand for; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    fields = T.StructType([encoded.schema[id_col], encoded.schema["ids"], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids.values.to_numpy(), shared.value) if ids.is_valid else b"" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], names=fields.names)

    return encoded.select(id_col, "ids").mapInArrow(run, fields)


def digests(encoded: DataFrame, tokens: list[bytes], id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): of the ids as little-endian unsigned 32-bit integers, and of what they decode to.

    It decodes as `decode` does, in the same pass, so that the bytes of the texts need not leave the task.
    """
    import hashlib

    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    fields = T.StructType([
        encoded.schema[id_col], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_sha, texts_sha = [], [], []
            for ids in batch.column(1):
                values = (ids.values.to_numpy() if ids.is_valid else np.zeros(0)).astype("<u4")
                counts.append(len(values))
                ids_sha.append(hashlib.sha256(values.tobytes()).hexdigest())
                texts_sha.append(hashlib.sha256(decode_ids(values, shared.value)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(texts_sha, pa.string())], names=fields.names)

    return encoded.select(id_col, "ids").mapInArrow(run, fields)
