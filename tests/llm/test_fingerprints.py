import hashlib

import xxhash
from pyspark.sql import functions as F

from lavra.llm import fingerprints as fp

MASK = (1 << 64) - 1


def shingles(text):
    ws = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").lower().split()]
    chain = lambda run, s=42: s if not run else chain(run[1:], xxhash.xxh64_intdigest(run[0].to_bytes(8, "little"), s))
    hs = {chain(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    return hs


def at(hs, bits):
    return {h for h in hs if h >> (64 - bits) == 0}


def brute(text, bits=3, least=16):
    hs = shingles(text)
    level = max([b for b in range(bits + 1) if len(at(hs, b)) >= least], default=0)
    return level, at(hs, level)


def like(a, b):
    level = max(a[0], b[0])
    a, b = at(a[1], level), at(b[1], level)
    return len(a & b) / len(a | b) if a | b else 1.0


def signed(hs):
    return sorted(h - (1 << 64) if h >> 63 else h for h in hs)


def texts():
    w = "the quick brown fox jumps over a lazy dog while ten more dogs look on and bark at night".split()
    long = " ".join(w[(i * i + i // 7) % len(w)] + str(i % 97) for i in range(5000))
    grown = [(60 + k, " ".join(long.split()[:k])) for k in (6, 19, 20, 33, 60, 90, 150)]
    return grown + [(7, " ".join(w)), (3, None), (12, ""), (5, "one two"), (40, long), (41, long), (9, "çé ñ 你好 \U0001f600 fim do texto aqui agora"), (90, "   ")]


def test_compare_edits_matches_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("next_id", F.lit(1)).repartition(3)
    got = {r.doc_id: r for r in fp.compare_edits(df).collect()}
    order = sorted(rows, key=lambda r: r[0])
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[k]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        level, _, hashes = r.fingerprint.partition(":")
        assert (int(level), [int(x, 16) for x in hashes.split()]) == (brute(t)[0], [h & MASK for h in signed(brute(t)[1])])
        assert r.near_edited == like(brute(t), brute(edited))
        assert r.near_next == like(brute(t), brute(nxt))


def test_repeated_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (None, "x y z"), (2, "c d e f g h i j")], "doc_id long, text string")
    got = fp.compare_edits(df).collect()
    assert len(got) == 5
    assert [r.near_next for r in got if r.doc_id is None] == [0.0]
    assert fp.compare_edits(df.limit(0)).collect() == []


def test_merge_and_containment(spark):
    words = dict(texts())[40].split()
    pieces = [" ".join(words[lo:hi]) for lo, hi in ((0, 0), (0, 6), (3, 30), (10, 40), (0, 90), (80, 200), (0, 400), (0, 5000))]
    df = spark.createDataFrame([(a, b) for a in pieces for b in pieces], "a string, b string")
    got = df.select("a", "b", fp.merge(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("m"), fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("c"))
    seen = set()
    for r in got.collect():
        union = shingles(r.a) | shingles(r.b)
        level = max([k for k in range(4) if len(at(union, k)) >= 16], default=0)
        assert (r.m.bits, r.m.hashes) == (level, signed(at(union, level)))
        (la, x), (lb, y) = brute(r.a), brute(r.b)
        part, whole = at(x, max(la, lb)), at(y, max(la, lb))
        assert r.c == (1.0 if not x else len(part & whole) / len(part) if part else None)
        seen.add(r.c)
    assert {None, 0.0, 1.0} < seen


def test_short_texts_are_compared_exactly(spark):
    a, b = "one two three four five six seven eight", "one two three four five six seven nine"
    whole = "zero " + a
    df = spark.createDataFrame([(a, b, whole)], "a string, b string, w string")
    r = df.select(
        fp.likeness(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("ab"),
        fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("w"))).alias("aw"),
        fp.containment(fp.sketch(F.col("w")), fp.sketch(F.col("a"))).alias("wa"),
    ).first()
    assert (r.ab, r.aw, r.wa) == (3 / 5, 1.0, 4 / 5)
    # A text of two shingles within a very long one: all hashes of the long text decide.
    long = dict(texts())[40]
    inside = spark.createDataFrame([(" ".join(long.split()[100:106]), long)], "a string, b string")
    c = inside.select(fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("b"), 0)).alias("c")).first().c
    assert c == 1.0
