"""The keyed store, against anti-joins and merges over whole tables."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from lavra.operators import chunks, rows
from lavra.sources.keyed import KeyedStore


def digests(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(path).glob("data/**/*.parquet")}


def test_missing_keys_open_few_files_and_equal_the_anti_join(spark, tmp_path):
    stored = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("chunk_key"), (F.col("id") % 7).alias("v"))
    store = KeyedStore(spark, str(tmp_path / "s"), stored.schema, "chunk_key", bits=4, file_rows=300)
    assert store.version() == 0 and store.read().count() == 0
    assert store.missing(stored.limit(3)).count() == 3
    store.append(stored.where("v < 4"))
    store.append(store.missing(stored))
    assert store.version() == 2 and store.read().count() == 20_000
    everything = store.manifest().count()
    assert everything > 60
    new = spark.range(200).select(F.concat(F.lit("new"), F.col("id")).alias("chunk_key"), F.lit(0).cast("long").alias("v"))
    assert store.may_hold(new).count() < 0.1 * everything
    some = stored.where("chunk_key in ('k5', 'k77')").unionByName(new)
    assert store.may_hold(some).count() < 0.1 * everything + 2
    assert sorted(store.missing(some).collect()) == sorted(some.join(store.read(), "chunk_key", "left_anti").collect())
    # Another session finds the same table, whatever number of buckets it asks for.
    again = KeyedStore(spark, str(tmp_path / "s"), stored.schema, "chunk_key", bits=2)
    assert again.bits == 4 and again.missing(some).count() == 200


def test_null_and_empty_keys_are_keys(spark, tmp_path):
    df = spark.createDataFrame([("", 1), (None, 2), ("a", 3)], "key string, ordem int")
    store = KeyedStore(spark, str(tmp_path / "s"), df.schema, "key", bits=1)
    assert store.merge(df.where("ordem = 1"), "ordem").count() == 1
    assert sorted(r.ordem for r in store.missing(df).collect()) == [2, 3]
    assert store.merge(df, "ordem").count() == 2 and store.merge(df, "ordem").count() == 0
    assert store.read().count() == 3


def test_merges_equal_merge_items_and_leave_other_files_as_they_are(spark, tmp_path):
    path = str(tmp_path / "s")
    item = lambda ids, ordem: ids.select(F.concat(F.lit("u"), F.col("id") % 997).alias("key"), ordem.alias("ordem"), F.col("id").alias("v"))
    old, new = item(spark.range(600), F.col("id") % 5), item(spark.range(300, 2500, 7), F.col("id") % 3)
    store = KeyedStore(spark, path, old.schema, "key", bits=5)
    first = rows.merge_items(old, old.limit(0), "key", "ordem").drop("estado")
    store.append(first)
    store.merge(new, "ordem")
    want = rows.merge_items(old, new, "key", "ordem").drop("estado")
    assert sorted(store.read().collect()) == sorted(want.collect())
    before = digests(path)
    one = spark.createDataFrame([("another", 9, 9), ("another", 1, 1)], old.schema)
    version = store.version()
    assert [tuple(r) for r in store.merge(one, "ordem").collect()] == [("another", 1, 1)]
    after = digests(path)
    assert before.items() <= after.items() and len(after) == len(before) + 1
    kept = store.manifest().join(store.manifest(version), "file", "left_semi").count()
    assert kept == store.manifest(version).count() - 1
    # What is stored already changes nothing, not even the version.
    assert store.merge(old, "ordem").count() == 0 and store.version() == version + 1
    assert store.read(version).count() == store.read().count() - 1


def test_a_run_that_fails_before_its_manifest_leaves_the_version_before(spark, tmp_path, monkeypatch):
    df = spark.range(50).select(F.col("id").cast("string").alias("key"), F.col("id").alias("ordem"))
    store = KeyedStore(spark, str(tmp_path / "s"), df.schema, "key", bits=2)
    store.merge(df.where("ordem < 30"), "ordem")
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.merge(df, "ordem")
    other = KeyedStore(spark, str(tmp_path / "s"), df.schema, "key")
    assert other.version() == 1 and other.read().count() == 30
    assert other.merge(df, "ordem").count() == 20 and other.read().count() == 50


def test_the_vector_job_on_a_keyed_store(spark, tmp_path):
    corpus = spark.createDataFrame([(f"d{k}", f"text {k}\n\nmore {k}", k % 5 > 0) for k in range(40)], "fonte string, texto string, na_janela boolean")
    store = chunks.vector_store(spark, str(tmp_path / "keyed"))
    plain = str(tmp_path / "plain")
    half = corpus.where("fonte < 'd3'")
    for part in (half, corpus):
        seen = spark.read.parquet(plain) if part is corpus else None
        want = chunks.index_documents(part, plain, chunks.hashing_encoder(8), seen).first()
        assert chunks.index_into(part, store, chunks.hashing_encoder(8)).first() == want
    cells = lambda df: sorted((r.chunk_key, r.texto, tuple(r.embedding)) for r in df.collect())
    assert cells(store.read()) == cells(spark.read.parquet(plain))
