import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lavra.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(tokens):
    ranks = {t: i for i, t in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "  ", "a  b", "a b ", " a b", "\n a\n b \n", "don't WE'LL it's", "x" * 3000, "ab" * 2000 + " !!", "你好 \U0001f600 é́ ½²",
    "tabs\tand\x0bmore\x1c1\x85x\xa0y", "end.\nStart of\n\nnext", "<|endoftext|> 12345 a1", "z 　 q r",
]


def test_perfect_hash(tokens):
    table = bpe.PerfectHash(tokens)
    assert all(table.get(t) == i for i, t in enumerate(tokens))
    assert sorted(table.values) == list(range(len(tokens)))
    assert table.get(b"no such token at all") is None and table.get(b"") is None


def test_encoder_equals_tiktoken(tokens, reference):
    chars = [f"a{chr(c)}b {chr(c)}{chr(c)} c" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = ODD + chars
    got = list(bpe.Encoder(tokens, bpe.PerfectHash(tokens), public_tokenizers.PATTERN).encode(texts))
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == reference.encode_ordinary(t), repr(t)


def test_round_trip(spark, tokens, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "null id"), (1, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'q' as bytes")
    encoded = bpe.encode(docs, tokens, public_tokenizers.PATTERN)
    got = sorted(map(tuple, bpe.digests(encoded, tokens).collect()), key=str)
    want = []
    for k, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sorted((bytes(r.bytes) for r in bpe.decode(encoded, tokens).collect())) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(docs.limit(0), tokens, public_tokenizers.PATTERN).collect() == []
