import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lavra.llm import catalog, runs


def plain_runs(words, least=12):
    """All runs by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts():
    rng = random.Random(5)
    out = [list("a" * n) for n in (1, 11, 12, 13, 64, 200)] + [list("ab" * 40), list("aab" * 30), fibonacci(150), fibonacci(233)]
    for _ in range(250):
        words = []
        while len(words) < rng.randrange(1, 160):
            root = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 25))]
            words += root * rng.randrange(1, 5) + root[: rng.randrange(len(root) + 1)]
            if rng.random() < 0.3:
                words += words[-rng.randrange(1, 60) :]
        out.append(words)
    for n in (3, 7, 8, 9, 16, 31):
        # Progressions of one word on both sides of a gap.
        out += [list("a" * n + "b") * 3, list("a" * n + "b" + "a" * (n - 1) + "b") * 2, list("ab" * n + "b") * 2 + list("ab" * n)]
    return out


def test_find_runs_equals_trying_every_period():
    for group in (texts(), *([t] for t in texts()[:40])):
        names = {w: i for i, w in enumerate(sorted({w for t in group for w in t}))}
        bounds = np.cumsum([0] + [len(t) for t in group])
        codes = np.array([names[w] for t in group for w in t])
        start, length, period = runs.find_runs(codes, bounds)
        owner = np.searchsorted(bounds, start, side="right") - 1
        for i, t in enumerate(group):
            mine = owner == i
            assert list(zip(start[mine] - bounds[i], length[mine], period[mine])) == plain_runs(t), t


def test_proposals_stay_linear_on_one_word_and_on_two_regions():
    for words in ("a" * 40_000, "a" * 20_000 + "b" + "a" * 19_999, "ab" * 20_000):
        codes = np.frombuffer(words.encode(), np.uint8).astype(np.int64) - 97
        bounds = np.array([0, len(codes)])
        start, end = np.zeros(len(codes), np.int64), np.full(len(codes), len(codes))
        level, m = codes.astype(np.int32), 1
        while m < 8192:
            level = runs._next_level(level, m, end, np.zeros(len(codes), np.int32))
            m *= 2
            assert len(runs._proposals(codes, level, m, start, end)[0]) <= 3 * len(codes)
        assert (0, len(codes)) in set(zip(*(x.tolist() for x in runs.find_runs(codes, bounds)[:2]))) or "b" in words


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(5, np.int64), np.array([0, 5]), least=4)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(plain_collapse(words, found))),
    )


def test_query_equals_plain_rows(spark, tmp_path):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts())]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, "x " * 30), (1003, "é ü " * 20), (1003, "é ü " * 20), (1004, "w\x0bw\fw\r\n" * 9), (1005, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as __bytes", "'x' as start")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(i, t) for i, t in rows if i != 1005]
    found = [tuple(r) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((r for r in found if r[0] != 1005), key=key) == sorted(want, key=key)
    [long] = [r for r in found if r[0] == 1005]
    assert long[1:5] == (1, 0, 60_000, 1)


def test_empty_table(spark):
    assert runs.word_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
