"""WARC: writing archives, reading them back, and assembling transactions.

Each record is a gzip member of its own, written by Spark's text writer with an empty member as line
separator; so files appear by Spark's commit protocol in any store it can write to, and can be entered at
any record. Files are bounded by bytes and by records. Reading unpacks a file piece by piece and follows
each record's Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.llm.text import let
from lavra.sources.scratch import written

EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records per file, and bytes before compression after which a task begins another: they bound what one reading task holds.
MAX_RECORDS = 60_000
FILE_BYTES = 128_000_000
#: Bytes that are unpacked, of a member's beginning (what follows a short member is copied) and further on, and bytes
#: of payloads that are handed on, at once.
FIRST_PIECE, PIECE, BATCH_BYTES = 1_024, 65_536, 8_000_000
#: A header of more bytes is broken.
HEAD_BYTES = 1_000_000
#: No record has a longer length than so many digits can say.
LENGTH_DIGITS = 18
_EMPTY_MEMBER = zlib.compress(b"", wbits=31)
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads from this size on are written once only.
MIN_REVISIT = 0

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("http_head", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("read_digest", T.StringType()),
])


def base32(digest: Column) -> Column:
    """Upper-case base32 of hexadecimal SHA-1 digests: every five hexadecimal digits are four letters."""

    def letters(n: Column) -> Column:
        return F.concat(*(F.substr(F.lit(_BASE32), F.shiftright(n, at).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for at in (15, 10, 5, 0)))

    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: let(F.conv(F.substr(digest, 5 * k + 1, F.lit(5)), 16, 10).cast("int"), letters))
    return F.array_join(fives, "")


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Rows (page_id, url, payload, sha, first_page) of pages (page_id, url, html).

    first_page is the smallest page_id among pages of equal payload (of at least `min_revisit` bytes),
    null for that page itself; it is then the page that this one revisits. Only ids and digests are
    compared; pages meet their decision by page_id, which no payload shared by many makes uneven.
    Null html is empty; null ids never are a first page. Rows equal in id and
    payload are one capture. Other columns are not carried.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    light = written(pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("bytes")), "digests")
    firsts = light.groupBy("sha", "bytes").agg(F.min("page_id").alias("first"))
    # A table of its own, so that the planner can split what very many pages share.
    firsts = written(firsts.where((F.col("bytes") >= min_revisit) & F.col("first").isNotNull()), "first-pages")
    revisits = light.distinct().join(firsts, ["sha", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(
        F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), F.col("first").alias("first_page")
    )
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha"))
    return full.join(revisits, same, "left").select("page_id", "url", "payload", "sha", "first_page")


def _record(kind: str, uuid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record, as binary; null headers are left out."""
    named = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.concat(F.lit("<"), uuid, F.lit(">"))), *headers]
    lines = F.concat_ws("", *(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)) for name, value in named))
    head = F.concat(F.lit("WARC/1.1" + EOL), lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL))
    return F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit(EOL + EOL), "UTF-8"))


def record_uuid(kind: str, page_id: Column, sha: Column) -> Column:
    """A name for a record that depends on nothing but its page."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), sha))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _line(value: Column) -> Column:
    """A header value must stay on its line."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_archive(decided: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", max_records: int = MAX_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Writes a response or revisit per page, and the request and metadata that belong to it, as WARC 1.1.

    A revisit carries the HTTP head alone and names the record it refers to. Requests and metadata
    name their response by WARC-Concurrent-To. Page ids go into a metadata field.
    """
    d = decided.withColumn("url", _line(F.coalesce("url", F.lit(""))))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha")))
    d = d.withColumn("digest", digest).withColumn("again", F.col("first_page").isNotNull())
    main = F.when(F.col("again"), record_uuid("revisit", F.col("page_id"), F.col("sha"))).otherwise(record_uuid("response", F.col("page_id"), F.col("sha")))
    d = d.withColumn("main_id", main).withColumn("first_id", F.when(F.col("again"), record_uuid("response", F.col("first_page"), F.col("sha"))))
    link = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    to_main = [*common, ("WARC-Concurrent-To", link(F.col("main_id")))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(EOL + EOL))
    of_payload = [*common, ("WARC-Payload-Digest", F.col("digest")), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", F.col("main_id"), of_payload, F.concat(F.encode(http, "UTF-8"), F.col("payload")))
    revisit = _record("revisit", F.col("main_id"), [*of_payload, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", link(F.col("first_id")))], F.encode(http, "UTF-8"))
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    request = _record(
        "request", record_uuid("request", F.col("page_id"), F.col("sha")), [*to_main, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.encode(F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)), "UTF-8"),
    )
    metadata = _record(
        "metadata", record_uuid("metadata", F.col("page_id"), F.col("sha")), [*to_main, ("Content-Type", F.lit("application/warc-fields"))],
        F.encode(F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL)), "UTF-8"),
    )
    records = d.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    fields = T.StructType([T.StructField("value", T.BinaryType()), T.StructField("part", T.IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            members, parts = [], []
            for value in batch.column(0):
                raw = value.as_py()
                parts.append(size // file_bytes)
                size += len(raw)
                members.append(_member(raw))
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(parts, pa.int32())], names=fields.names)

    # The cast keeps bytes that are no UTF-8; the text writer passes them on as they are.
    packed = records.mapInArrow(pack, fields).select(F.col("value").cast("string").alias("value"), "part")
    options = {"lineSep": _EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1", "compression": "none", "maxRecordsPerFile": max_records}
    packed.write.partitionBy("part").options(**options).text(path)


def _member(raw: bytes) -> bytes:
    """A gzip member. Higher levels take nearly twice the time for files smaller by a sixtieth."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31, 6)
    return packer.compress(raw) + packer.flush()


def _unpacked(data: bytes) -> Iterator[tuple[bool, bytes]]:
    """Pieces of what a file, plain or gzip, holds; each with whether a gzip member begins there.

    What lies between members, and what is broken within one, is passed over to the next that begins.
    """
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield at == 0, bytes(view[at : at + PIECE])
        return
    at = 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        if data.startswith(_EMPTY_MEMBER, at):
            at += len(_EMPTY_MEMBER)
            continue
        unzip, begins, begun, step = zlib.decompressobj(31), True, at, FIRST_PIECE
        try:
            while at < len(data) and not unzip.eof:
                piece = unzip.decompress(view[at : at + step])
                at, step = min(at + step, len(data)), min(8 * step, PIECE)
                if piece:
                    yield begins, piece
                    begins = False
            at -= len(unzip.unused_data)
        except zlib.error:
            at = begun + 3


_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n").match


class _Pieces:
    """What _unpacked gives, held from `at` on."""

    def __init__(self, data: bytes):
        self.source, self.held, self.at = _unpacked(data), bytearray(), 0
        self.begins: deque[int] = deque()  # where members begin

    def more(self) -> bool:
        found = next(self.source, None)
        if found is None:
            return False
        if self.at > 16 * PIECE:
            del self.held[: self.at]
            self.begins = deque(x - self.at for x in self.begins if x >= self.at)
            self.at = 0
        if found[0]:
            self.begins.append(len(self.held))
        self.held += found[1]
        return True

    def has(self, size: int) -> bool:
        while len(self.held) - self.at < size and self.more():
            pass
        return len(self.held) - self.at >= size

    def head(self) -> bytes | None:
        """The header lines that begin here, which `at` then follows; null where none does."""
        seen = self.at
        while self.has(5) and self.held.startswith(b"WARC/", self.at):
            stop = self.held.find(b"\r\n\r\n", seen)
            if 0 <= stop <= self.at + HEAD_BYTES:
                head, self.at = bytes(self.held[self.at : stop]), stop + 4
                return head
            back = len(self.held) - self.at
            if stop >= 0 or back > HEAD_BYTES or not self.more():
                return None
            seen = self.at + max(0, back - 3)
        return None

    def at_member(self) -> bool:
        """Whether a member begins here; the ones before are forgotten."""
        while self.begins and self.begins[0] < self.at:
            self.begins.popleft()
        return bool(self.begins) and self.begins[0] == self.at

    def block(self, size: int, at_member: bool) -> bytes | None:
        """The next `size` bytes; null where the file has fewer, or where they can't be one record's.

        That is so if the record began with its member, a later member that begins with a version line lies
        among the bytes, and they don't end where a member begins. Reading goes on at that member then.
        """
        whole = self.has(size)
        end, inside = self.at + size, None
        if at_member:
            for x in self.begins:
                if x >= end:
                    break
                if x > self.at and _VERSION(self.held, x):
                    inside = x - self.at
                    break
        if inside is not None and whole:
            after = size
            while self.has(after + 1) and self.held[self.at + after] in b"\r\n\0":
                after += 1
            if self.at + after in self.begins or not self.has(after + 1):
                inside = None
        if inside is not None:
            self.at += inside
            return None
        found = bytes(self.held[self.at : self.at + size]) if whole else None
        self.at += size if whole else len(self.held) - self.at
        return found

    def skip(self) -> bool:
        """To the next record after a broken one: where a later member begins with one, else after the next empty lines before a version line."""
        last = self.at
        while True:
            for x in self.begins:
                if x > last:
                    self.at = x
                    if self.has(5) and self.held.startswith(b"WARC/", self.at):
                        return True
                    last = self.at
                    break
            else:
                back = last - self.at
                self.at = min(self.at, last)
                if not self.more():
                    break
                last = self.at + back
        found = self.held.find(b"\r\n\r\nWARC/1.", self.at)
        self.at = found + 4 if found >= 0 else len(self.held)
        return found >= 0


def _records(data: bytes) -> Iterator[dict]:
    """The records of one file, plain or gzip (one member for each record, or any other way)."""
    pieces = _Pieces(data)
    while True:
        while pieces.has(1) and pieces.held[pieces.at] in b"\r\n\0":
            pieces.at += 1
        if not pieces.has(5):
            return
        at_member = pieces.at_member()
        head = pieces.head()
        fields, several = {}, []
        for line in (head or b"").decode("utf-8", "replace").split(EOL)[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                several.append(value.strip("<>"))
            fields[name] = value
        size = fields.get("content-length", "")
        if not size.isascii() or not size.isdigit() or len(size) > LENGTH_DIGITS:
            if not pieces.skip():
                return
            continue
        block = pieces.block(int(size), at_member)
        if block is None:
            continue
        head = None
        if fields.get("content-type", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            head = head.decode("utf-8", "replace")
        digest = fields.get("warc-payload-digest", "")
        yield {
            "record_id": fields.get("warc-record-id", "").strip("<>") or None, "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"), "concurrent_to": several, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": digest.partition(":")[2] or None, "content_type": fields.get("content-type"), "http_head": head,
            "fields": list(fields.items()), "payload": block, "payload_bytes": len(block),
            "read_digest": base64.b32encode(hashlib.sha1(block).digest()).decode(),
        }


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; see RECORD. read_digest is of the payload as read.

    Passed over are: records cut short by the end of their file, those whose length reaches into a later
    member that begins with a record (reading goes on there), those without a number of at most LENGTH_DIGITS
    digits as Content-Length
    (reading goes on at the next gzip member that begins with a record, or in other files after the next
    empty lines before a version line), broken gzip members, and bytes between members or after the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(RECORD)
        for batch in batches:
            for content in batch.column(0):
                some, size = [], 0
                for record in _records(content.as_py()):
                    some.append(record)
                    size += record["payload_bytes"]
                    if len(some) == 500 or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_struct_array(pa.array(some, kind))
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_struct_array(pa.array(some, kind))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, record (response, revisit or resource), request, metadata (array).

    Other records find their capture by concurrent-to: they name it, or it names them, or they name a
    request that names it. A capture without any still gives a row. Records that find no capture are
    left out; they are what `orphans` returns. The smallest record id is the request of a capture that
    several claim to be. Repeated record ids are one record.
    """
    main, linked = _linked(records)
    by_capture = linked.where("capture_id is not null").groupBy("capture_id").agg(
        F.min(F.when(F.col("r.record_type") == "request", F.col("r"))).alias("request"),
        F.array_sort(F.collect_list(F.when(F.col("r.record_type") == "metadata", F.col("r")))).alias("metadata"),
    )
    joined = main.join(by_capture, main.record_id == by_capture.capture_id, "left")
    return joined.select(main.record_id.alias("capture_id"), *[main[c] for c in main.columns if c != "record_id"], "request", F.coalesce("metadata", F.array()).alias("metadata"))


def orphans(records: DataFrame) -> DataFrame:
    """Ids of the requests and metadata that no capture could be found for."""
    return _linked(records)[1].where("capture_id is null").select("r.record_id")


def _linked(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = records.where("record_id is not null")
    is_main = F.col("record_type").isin("response", "revisit", "resource")
    is_side = F.col("record_type").isin("request", "metadata")
    main = named.where(is_main).dropDuplicates(["record_id"])
    side = named.where(is_side).dropDuplicates(["record_id"])
    side = side.select(F.struct("record_id", "record_type", "date", "concurrent_to", "http_head", F.map_entries("fields").alias("fields"), F.decode("payload", "UTF-8").alias("text")).alias("r"))
    # (record, capture) links in both directions, and through a request: ids only, found once and written.
    ids = named.where(is_main | is_side).select("record_id", is_main.alias("main"), F.explode_outer("concurrent_to").alias("target")).distinct()
    ids = written(ids, "links")
    names = ids.where("not main and target is not null").select(F.col("record_id").alias("id"), "target")
    captures = ids.where("main").select(F.col("record_id").alias("capture_id")).distinct()
    direct = names.join(captures, names.target == captures.capture_id).select("id", "capture_id")
    named_by = ids.where("main and target is not null").select(F.col("target").alias("id"), F.col("record_id").alias("capture_id"))
    near = written(direct.unionByName(named_by), "near-links")
    through = names.join(near.withColumnRenamed("id", "target"), "target").select("id", "capture_id")
    found = near.withColumn("hops", F.lit(1)).unionByName(through.withColumn("hops", F.lit(2)))
    found = found.groupBy("id").agg(F.min(F.struct("hops", "capture_id")).alias("best")).select("id", F.col("best.capture_id").alias("capture_id"))
    return main, side.join(found, F.col("r.record_id") == found.id, "left").select("r", "capture_id")


def page_digests(records: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of the captures read back.

    The page id comes from the capture's metadata. A revisit has the full payload of the response that
    it refers to, whose digest must be the one it was written with.
    """
    # Only what digests come from: without the payloads and other headers the records are small. Written, they let
    # the archives be read once.
    kinds = {f.name: f.dataType for f in RECORD.fields}
    light = records.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("fields", "http_head", "target_uri", "content_type", "date")})
    light = written(light.withColumn("payload", F.when(F.col("record_type") == "metadata", F.col("payload"))), "records")
    own = assemble(light).select(
        "capture_id", "record_type", F.col("refers_to").alias("first_id"),
        F.regexp_extract(F.get("metadata", F.lit(0))["text"], r"page-id: (\S*)", 1).alias("page"),
        F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("read_digest")).alias("digest"),
        "payload_bytes",
    )
    own = written(own, "captures")
    firsts = own.where("record_type = 'response'").select(F.col("capture_id").alias("f_id"), F.col("page").alias("f_page"), F.col("payload_bytes").alias("f_bytes"), F.col("digest").alias("f_digest"))
    revisits = own.where("record_type = 'revisit'")
    same = (revisits.first_id == firsts.f_id) & (revisits.digest == firsts.f_digest)
    back = revisits.join(firsts, same, "left").select("page", F.col("f_bytes").alias("payload_bytes"), "digest", "record_type", "f_page")
    others = own.where("record_type <> 'revisit'").select("page", "payload_bytes", "digest", "record_type", F.lit(None).cast("string").alias("f_page"))
    return others.unionByName(back).select(
        F.col("page").try_cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("f_page").try_cast("long").alias("refers_to"),
    )
