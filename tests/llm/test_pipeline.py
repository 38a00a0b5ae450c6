"""Every stage of the pipeline against a plain version of it, over the rows that reach it."""

import re
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from lavra.llm import quality
from tests.llm import test_jaccard, test_linededup

SF = "/root/testdata/sf0.001"
PRIVATE = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b4\d{15}\b|AKIA[0-9A-Z]{16}|(?:token = \"|password=)[0-9a-f]+|(?<![\w.])\d+\.\d+\.\d+\.\d+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows.append(docs.collect())
        if k < 4:
            assert docs.columns == columns, name
            assert all(r.n_chars == len(r.text) for r in rows[-1])
    raw, good, lines, single, private, packed = rows
    text = lambda rs: {r.doc_id: r.text for r in rs}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = text(good)
    assert kept.items() <= text(raw).items()
    assert sum((k in kept) == bool(v) for k, v in labels.items()) / len(labels) > 0.97
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()
    assert {r.doc_id for r in scored if r.probability >= 0.5} == set(kept)

    assert sorted(text(lines).items(), key=str) == [(k, t) for k, t, _, _ in test_linededup.plain_passages(list(kept.items()))]
    assert sorted(r.doc_id for r in single) == sorted({c for _, c, _, _ in test_jaccard.brute(list(text(lines).items()))})
    assert text(single).items() <= text(lines).items()

    old, new = text(single), text(private)
    assert old.keys() == new.keys()
    gone = {m for t in old.values() for m in PRIVATE.findall(t)}
    assert gone and not any(m in t for t in new.values() for m in gone)
    assert all(new[k] == t for k, t in old.items() if not re.search(r"[@\d]", t))

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k, t in new.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[k, p] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1
