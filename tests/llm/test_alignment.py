import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lavra.llm import alignment, catalog

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
with open(LEFT, encoding="utf-8") as f:
    LEFT_JSON = f.read()
with open(RIGHT, "rb") as f:
    RIGHT_MODEL = f.read()


@pytest.fixture(scope="module")
def whole():
    """Tokens and byte ends of whole texts, by the libraries alone."""
    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in itself} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in itself)}

    def tokens(text):
        if not text:
            return None
        e = left.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in left.id_to_token(i))) for i in e.ids]
        b = []
        for i in right.encode(text):
            p = right.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and right.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None

    return tokens


def plain(rows, tokens):
    """The agreed columns, by comparing all byte ranges."""
    per, held = [], defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        found = tokens(text)
        if found is None:
            per.append((doc_id, 0, 0, [], ""))
            continue
        spans = []
        for side in found:
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        a, b = spans
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if low <= x[1] and x[2] <= end) for side in (a, b)))
            low = end
        for link in set(links):
            held[link].add(n)
        per.append((doc_id, len(a), len(b), links, ";".join(groups)))
    counts = {k: len(v) for k, v in held.items()}
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (d, a, b, g.count(";") + 1 if g else 0, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, a, b, links, g in per
    ]


TEXTS = [
    None, "", " ", "\n", "a", "word", "two words", " lead", "trail ", "a  b", "a\nb", "a\n\nb", "\na", "a\n", "a \nb", "a\n b", "tab\there", "a\r\nb", "a\x1cb \x1cc\x1d d", "nb sp  x",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "it's we'll they've 'tis", "▁", "a ▁b", "日本語 テキスト。混ぜる", "👩‍👩‍👧 emoji 🎉🎉", "Ünïcödé ñandú œuvre", "é combining", "x" * 500, "ab" * 3000,
    "12345 67,890.12 €5", "http://a.b/c?d=e&f#g", "  \n \n  x  \n", "fullwidth Ａ１", " line par", "﻿bom", "मानक हिन्दी", "same text", "same text", "zero\x00byte", "a\x85b \x85c",
]


def many():
    rng = random.Random(3)
    parts = ["the", "of", "Word", "naïve", "straße", "x1", "...", "don't", "C++", "--", "世界", "é", "ing", "\t", "　", "▁", "1999", "(a)", "\n"]
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n", "  "]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return list(enumerate(TEXTS + made)) + [(None, "the of"), (7, "again")]


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: (r[0] is None, r))


def test_equals_whole_texts_by_the_libraries(spark, whole):
    rows = many()
    want = sorted(plain(rows, whole), key=lambda r: (r[0] is None, r))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as run", "3 as radix", "4 as id", "'g' as groups")
    assert rows_of(alignment.align_documents(docs.repartition(3), LEFT_JSON, RIGHT_MODEL)) == want
    # Many runs of few records, radixes merged in parts.
    small = alignment.align_documents(docs.repartition(3), LEFT_JSON, RIGHT_MODEL, run_records=300, radix=5, merge_records=1000)
    assert rows_of(small) == want
    groups = alignment.align_documents(docs.where("doc_id = 6"), LEFT_JSON, RIGHT_MODEL, with_groups=True).first()
    assert hashlib.sha256(groups["groups"].encode()).hexdigest() == groups["groups_sha256"]


def test_query_on_tables_without_rows_and_without_tokens(spark, tmp_path):
    for name, rows in (("none", []), ("blank", [(1, None), (1, None), (2, "")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = catalog.op12_alignment(spark, f"{tmp_path}/{name}")
        assert sorted(r[0] for r in got.collect()) == [r[0] for r in rows]
        assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in got.collect())


def test_runs_come_back_and_merge_like_one_table():
    rng = np.random.default_rng(1)
    runs, all_records = [], []
    for k in range(7):
        n = int(rng.integers(1, 400))
        keys = np.unique(rng.integers(0, 40 * 32, n) << 20 | rng.integers(0, 30, n))
        codes, rows, times = keys >> 20, (keys & 0xFFFFF) + (k << 33), rng.integers(1, 300, len(keys))
        run = alignment.pack_run(codes, rows, times)
        got_codes, sizes, least, got_rows, got_times = alignment.open_run(run)
        assert (np.repeat(got_codes, sizes) == codes).all() and (got_rows.astype(np.int64) + least == rows).all() and (got_times == times).all()
        runs.append(run)
        all_records += codes.tolist()
    seen = {}
    lefts = []
    for a, right, counts, _ in alignment.merge_runs(runs, 32):
        lefts.append(a)
        seen |= {a * 32 + int(b): int(n) for b, n in zip(right, counts)}
    assert lefts == sorted(set(lefts))
    assert seen == {c: all_records.count(c) for c in set(all_records)}
