import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from lavra.llm import catalog, linededup


def brute_chunks(text, window=2, bits=2):
    lines = text.split("\n")
    h = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(x.encode(), 42)))[0] for x in lines]
    out, cur = [], []
    for i, line in enumerate(lines):
        cur.append(line)
        seed = 42
        for k in range(window):
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h[i - k] if i >= k else 0), seed)
        if seed >> (64 - bits) == 0 or i == len(lines) - 1:
            out.append(cur)
            cur = []
    return out


def brute(rows):
    seen, out = {}, []
    places = [(k, i, t, c) for k, t in set(rows) if t is not None for i, c in enumerate(brute_chunks(t)) if len(c) > 1 and any(x.strip() for x in c)]
    for k, i, t, c in sorted(places, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        seen.setdefault("\n".join(c), (k, i, t))
    for k, t in rows:
        if t is None:
            out.append((k, None))
            continue
        kept = [c for i, c in enumerate(brute_chunks(t)) if seen.get("\n".join(c), (k, i, t)) == (k, i, t)]
        out.append((k, "\n".join(x for c in kept for x in c)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    shared = [f"shared line {i} of a passage" for i in range(14)]
    rows = []
    for k in range(40):
        own = [f"document {k} line {rng.random()}" for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(own))
        rows.append((k, "\n".join(own[:at] + (shared[rng.randint(0, 3) :] if k % 3 else []) + own[at:])))
    long = "\n".join(f"long {i % 700}" for i in range(6000))
    return rows + [(100, None), (101, ""), (102, "\n\n\n\n\n"), (103, "\n\n\n\n\n"), (104, long), (105, long), (None, rows[1][1]), (106, "a\nb"), (106, "a\nb"), (107, "x\n" * 3)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "chunk": F.lit("c"), "removed_lines": F.lit("old")}).repartition(3)
    got = linededup.drop_repeated_chunks(df)
    assert got.columns == ["doc_id", "text", "k", "chunk", "removed_chunks", "removed_lines"]
    back = got.collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == brute(rows)
    before = dict(rows)
    assert all(r.removed_lines == 0 or len(before[r.doc_id].split("\n")) - r.removed_lines == (len(r.text.split("\n")) if r.text else 0) for r in back if r.doc_id is not None)
    assert sum(r.removed_chunks for r in back) > 10
    assert linededup.drop_repeated_chunks(df.limit(0)).collect() == []


def test_chunks_join_to_the_text(spark):
    rows = [(t,) for _, t in corpus() if t is not None]
    df = spark.createDataFrame(rows, "t string").withColumn("c", linededup.line_chunks(F.col("t")))
    for r in df.collect():
        assert [list(c) for c in r.c] == brute_chunks(r.t)


def plain_units(text):
    out = []
    for i, line in enumerate(text.split("\n")):
        if len(re.split(r"\s+", line)) < 50:
            out.append((line, i, line))
            continue
        for s in re.split(r"(?<=[.!?]\s)|(?<=[。！？])", line):
            tokens, cur = [s] if len(re.split(r"\s+", s)) < 50 else re.split(r"(?<=\s)", s), ""
            for k, x in enumerate(tokens):
                cur += x
                if k == len(tokens) - 1 or xxhash.xxh64_intdigest(x.strip().encode(), 42) >> 61 == 0:
                    out += [(cur, i, cur.strip())] if cur else []
                    cur = ""
    return out


def plain_passages(rows):
    first, out = {}, []
    known = {(k, t): plain_units(t) for k, t in rows if t is not None}
    pair = lambda u, i: (u[i][2], u[i][1] == u[i + 1][1], u[i + 1][2])
    ordered = sorted((k is not None, k or 0, i, t, k) for (k, t), u in known.items() for i in range(len(u) - 1))
    for _, _, i, t, k in ordered:
        first.setdefault(pair(known[k, t], i), (k, i, t))
    for k, t in rows:
        if t is None:
            out.append((k, t, 0, 0))
            continue
        u, gone = known[k, t], set()
        for i in range(len(u) - 1):
            a, p, b = first[pair(u, i)]
            if (u[i][2] + u[i + 1][2]).strip() and (a, p, b) != (k, i, t) and (a, p + 1, b) != (k, i, t):
                gone |= {i, i + 1}
        drop, runs, i = set(), 0, 0
        while i < len(u):
            j = i
            while j in gone:
                j += 1
            run = set(range(i, j))
            whole = {x[1] for q, x in enumerate(u) if q in run} - {x[1] for q, x in enumerate(u) if q not in run}
            if len(whole) > 1 or run and sum(len(re.split(r"\s+", u[q][2])) for q in run) >= 50:
                drop, runs = drop | run, runs + 1
            i = max(j, i + 1)
        lines = {}
        for q, x in enumerate(u):
            if q not in drop:
                lines[x[1]] = lines.get(x[1], "") + x[0]
        out.append((k, "\n".join(lines.values()), runs, len(t.split("\n")) - len(lines)))
    return sorted(out, key=str)


def test_passages_match_a_plain_version(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    many = " ".join(f"{say(9)}." for _ in range(8))
    endless = say(90)
    rows = corpus() + [(300 + k, f"{say(40)}. {many} {say(30)}.\n{say(5)}") for k in range(6)]
    rows += [(400 + k, f"{say(20)} {endless} {say(20)}") for k in range(4)] + [(500, "same\n" * 9), (501, "a\n\n\nb"), (502, "a\n\n\nb"), (503, many), (504, "x\nx\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "pos": F.lit("c"), "removed_lines": F.lit("old")}).repartition(3)
    got = linededup.drop_repeated_passages(df)
    assert got.columns == ["doc_id", "text", "k", "pos", "removed_chunks", "removed_lines"]
    assert sorted(((r.doc_id, r.text, r.removed_chunks, r.removed_lines) for r in got.collect()), key=str) == plain_passages(rows)
    assert linededup.drop_repeated_passages(df.limit(0)).collect() == []


def test_whole_passages_go_wherever_they_stand(spark, monkeypatch):
    short = [[f"passage {p} line {i}" for i in range(2 + p % 2)] for p in range(30)]
    long = " ".join(" ".join(f"word{s}x{i}" for i in range(9)) + "." for s in range(7))
    texts = {100 * side + p: "\n".join(["common line", f"own {side} {p}", *q, f"end {side} {p}"]) for p, q in enumerate(short) for side in (0, 1)}
    texts |= {900 + side: f"Begin {side} {'very ' * 60}own. {long} End {side} own." for side in (0, 1)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr("lavra.llm.catalog.table", lambda *_: frame)
    got = {r.doc_id: r.text for r in catalog.op7_line_dedup(spark, "")[["doc_id", "text"]].collect()}
    assert all(got[p] == texts[p] and got[100 + p] == f"common line\nown 1 {p}\nend 1 {p}" for p in range(30))
    assert got[900] == texts[900] and "word3x3" not in got[901] and got[901].startswith("Begin 1") and got[901].endswith("End 1 own.")


def test_simple_and_general_units_are_the_same(spark):
    rng = random.Random(8)
    bits = ["a", "bc. ", "d!", " e? ", "。", "f", " ", "word ", "g.h ", "！x", "long " * 60]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 60))),) for _ in range(200)]
    df = spark.createDataFrame([r for r in rows if "  " not in r[0]] + [("",), (("word " * 200).strip(),)], "t string")
    pieces = [linededup._pieces(F.col("t"), s) for s in (True, False)]
    long = [linededup._long(F.col("t"), s) for s in (True, False)]
    assert df.where((pieces[0] != pieces[1]) | (long[0] != long[1])).count() == 0
