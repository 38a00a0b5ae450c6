import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from lavra.llm import warc

ROWS = [
    (5, "http://a.example/x", "same"), (3, "http://b.example/y", "same"), (9, "HTTP://c.example", "same"), (1, "http://a.example/1", "only\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (2, None, None), (4, "http://d.example/\r\nX: y", ""), (7, "http://e.example", "ç" * 70000), (None, "http://n.example", "null id"), (None, "http://n.example", "same"),
]


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows, least=0):
    firsts = {}
    for k, _, t in rows:
        if k is not None:
            firsts[t or ""] = min(k, firsts.get(t or "", k))
    out = []
    for k, _, t in rows:
        t = t or ""
        again = len(t.encode()) >= least and t in firsts and firsts[t] != k
        out.append((k, len(t.encode()), sha(t), "revisit" if again else "response", firsts[t] if again else None))
    return sorted(out, key=str)


def run(df, tmp_path, least=0):
    path = str(tmp_path / f"w{least}")
    warc.write_archive(warc.decide(df, least), path, max_records=4)
    return path, warc.read_archive(df.sparkSession, path)


def test_pages_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("sha", F.lit(0)).withColumn("record_id", F.lit(0))
    for least in (0, 5):
        _, records = run(df, tmp_path, least)
        assert sorted(map(tuple, warc.page_digests(records).collect()), key=str) == brute(ROWS, least)
    assert warc.page_digests(run(df.limit(0), tmp_path, 1)[1]).collect() == []


def test_captures_are_nested(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path, records = run(df, tmp_path)
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert len(got) == len(ROWS)
    assert all(r.request.http_head.startswith("GET ") and len(r.metadata) == 1 for r in got.values())
    assert any(bytes(r.payload) == ("ç" * 70000).encode() for r in got.values())
    assert warc.orphans(records).collect() == []


def record(kind, rid, body=b"", **more):
    extra = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_links_in_every_direction(spark, tmp_path):
    parts = [
        record("warcinfo", "u:w"),
        record("response", "u:1", b"one", WARC_Concurrent_To="<u:q1>"),  # names its request
        record("request", "u:q1"), record("metadata", "u:m1", b"k: v", WARC_Concurrent_To="<u:q1>"),  # through the request
        record("resource", "u:2", b"two"), record("metadata", "u:m2", WARC_Concurrent_To="<u:2>"), record("metadata", "u:m3", WARC_Concurrent_To="<u:2>"),
        record("metadata", "u:lost", WARC_Concurrent_To="<u:nowhere>"), record("response", "u:3", b"three"), record("response", "u:3", b"three"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # one member for each record
    records = warc.read_archive(spark, str(tmp_path / "a.warc.gz"))
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert {k: (r.request and r.request.record_id, [m.record_id for m in r.metadata]) for k, r in got.items()} == {
        "u:1": ("u:q1", ["u:m1"]), "u:2": (None, ["u:m2", "u:m3"]), "u:3": (None, []),
    }
    assert [r.record_id for r in warc.orphans(records).collect()] == ["u:lost"]


def test_members_and_broken_files():
    plain = [record("response", f"u:{i}", b"WARC/1.1 inside\r\n\r\nWARC/1.1\r\n" + bytes([i]) * 50) for i in range(4)]
    ids = lambda data: [r["record_id"] for r in warc._records(data)]
    whole = b"".join(plain)
    members = b"".join(map(gzip.compress, plain))
    assert ids(whole) == ids(members) == ids(gzip.compress(whole)) == ["u:0", "u:1", "u:2", "u:3"]
    # Members that end anywhere, as parallel compressors write them.
    assert ids(b"".join(gzip.compress(whole[at : at + 37]) for at in range(0, len(whole), 37))) == ["u:0", "u:1", "u:2", "u:3"]
    assert ids(members + b"\0" * 512) == ids(members + b"junk") == ["u:0", "u:1", "u:2", "u:3"]
    assert ids(whole[:-20]) == ids(members[:-14]) == ["u:0", "u:1", "u:2"]
    broken = record("response", "u:x", b"text\r\n\r\nWARC/1.1\r\nWARC-Record-ID: <u:fake>\r\nContent-Length: 0\r\n\r\n").replace(b"Content-Length: 6", b"Content-Length: x")
    assert ids(gzip.compress(broken) + members) == ["u:0", "u:1", "u:2", "u:3"]
    assert ids(b"no record at all" + whole)[-3:] == ["u:1", "u:2", "u:3"]
    bad = bytearray(members)
    bad[len(gzip.compress(plain[0])) + 12] ^= 255
    assert {"u:0", "u:2", "u:3"} <= set(ids(bytes(bad)))
    assert ids(b"") == ids(b"\x1f\x8b") == []


def test_lengths_that_cannot_be():
    plain = [record("response", f"u:{i}", bytes([65 + i]) * 50) for i in range(4)]
    claim = lambda size: [p.replace(b"Content-Length: 50", f"Content-Length: {size}".encode()) if k == 1 else p for k, p in enumerate(plain)]
    members = lambda parts: b"".join(map(gzip.compress, parts))
    read = lambda data: {r["record_id"]: r["payload"] for r in warc._records(data)}
    whole = read(members(plain))
    assert len(whole) == 4
    others = {k: v for k, v in whole.items() if k != "u:1"}
    for size in (10**9, 57, 61, 120, 10**17, "9" * 5000, "9" * 19):
        assert read(members(claim(size))) == others, size
    # A few bytes too many within its own member can't be told from a payload.
    assert set(read(members(claim(53)))) == set(whole)
    assert {"u:0"} <= set(read(b"".join(claim("9" * 5000)))) and {"u:2", "u:3"} <= set(read(b"".join(claim("9" * 5000))))
    # A payload that begins with a version line where its record's member begins anew is whole: it ends with a member.
    nested = record("resource", "u:n", plain[0])
    at = nested.index(b"WARC/1.0", 5)
    assert read(gzip.compress(nested[:at]) + gzip.compress(nested[at:]) + members(plain[2:])) == {"u:n": plain[0]} | {k: whole[k] for k in ("u:2", "u:3")}


def test_reading_is_linear_in_members():
    import time

    def took(n):
        data = b"".join(gzip.compress(record("metadata", f"u:{i}", b"k: v")) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc._records(data)) == n
        return time.process_time() - began

    took(500)
    assert took(16_000) < 8 * max(took(4_000), 0.05)


def test_files_hold_a_member_per_record_and_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", f"{i}" * 3000) for i in range(40)]
    warc.write_archive(warc.decide(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), str(tmp_path / "w"), file_bytes=20_000)
    files = [f.read_bytes() for f in (tmp_path / "w").rglob("part-*")]
    assert len(files) > 4 and all(sum(r["payload_bytes"] for r in warc._records(f)) < 40_000 for f in files)
    unzipped = [gzip.decompress(f) for f in files]
    assert sum(u.count(b"WARC-Type: ") for u in unzipped) == 120
    for f in files:
        starts = [i for i in range(len(f)) if f[i : i + 3] == b"\x1f\x8b\x08"]
        assert len(starts) >= 2 * gzip.decompress(f).count(b"WARC-Type: ")
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 120


def test_base32_equals_the_standard_library(spark):
    df = spark.range(50).select(F.sha1(F.col("id").cast("string")).alias("h"))
    assert all(r.b == base64.b32encode(bytes.fromhex(r.h)).decode() for r in df.select("h", warc.base32(F.col("h")).alias("b")).collect())
