"""Chunks of documents, their vectors, and searches over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import chunks
from lavra.sources.keyed import KeyedStore
from lavra.sources.scratch import shared_folder, written
from lavra.sources.tables import table

TOKENS = 60
#: Queries of the batch search: every row whose id is a multiple of this.
QUERY_STEP = 50


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose lines are paragraphs."""
    return table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fonte"), F.col("lang").alias("tipo"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("texto"), "doc_id")


def made(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.explode_chunks(_corpus(spark, sf), tokens=TOKENS, carry=("tipo",))


def _store(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier run over every third document has stored."""
    return chunks.explode_chunks(_corpus(spark, sf).where("doc_id % 3 = 0"), tokens=TOKENS, carry=("tipo",))


def added(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.new_chunks(made(spark, sf), _store(spark, sf)).select("chunk_key", "texto")


def added_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """As added, with the stored chunks in a keyed store."""
    stored = _store(spark, sf)
    store = KeyedStore(spark, shared_folder(spark, "chunk-store"), stored.schema, "chunk_key")
    store.append(chunks.new_chunks(stored, stored.limit(0)))
    all_chunks = written(made(spark, sf), "chunks")
    return chunks.new_chunks(store.missing(all_chunks), all_chunks.limit(0)).select("chunk_key", "texto")


def present(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.existing_keys(made(spark, sf), _store(spark, sf))


def report(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    all_chunks = written(made(spark, sf), "chunks")
    return chunks.vector_report(c, c.where("texto <> ''"), all_chunks, chunks.new_chunks(all_chunks, _store(spark, sf)))


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.embed(made(spark, sf), chunks.hashing_encoder()).select("chunk_key", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


def _query(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").orderBy("vec_id").first().embedding)


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    found = chunks.top_k(table(spark, sf, "embeddings"), _query(spark, sf), 10, key="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


def above(spark: SparkSession, sf: str) -> DataFrame:
    found = chunks.top_k(table(spark, sf, "embeddings"), _query(spark, sf), 100, min_score=-0.5, key="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


def batch(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    queries = e.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = chunks.top_k_batch(e, queries, 5, key="vec_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "posicao")


#: What the search by text asks for.
QUESTION = "research on water and energy in the north"


def by_text(spark: SparkSession, sf: str) -> DataFrame:
    found = chunks.search_text(table(spark, sf, "embeddings"), QUESTION, chunks.hashing_encoder(), 10, min_score=-5.0, key="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


def by_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors to every 50th document."""
    asked = table(spark, sf, "documents").where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("texto"))
    return chunks.search_texts(table(spark, sf, "embeddings"), asked, chunks.hashing_encoder(), 5, key="vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "posicao")


def vector_job(spark: SparkSession, sf: str) -> DataFrame:
    """The report of a second run over all documents, after a first over every third; and how many rows and keys are stored then."""
    path = shared_folder(spark, "vector-store")
    corpus = _corpus(spark, sf).withColumn("na_janela", F.col("doc_id") % 7 > 0)
    chunks.index_documents(corpus.where("doc_id % 3 = 0"), path, chunks.hashing_encoder(), tokens=TOKENS)
    done = chunks.index_documents(corpus, path, chunks.hashing_encoder(), spark.read.parquet(path), tokens=TOKENS)
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("guardados"), F.count_distinct("chunk_key").alias("chaves"))
    return done.crossJoin(stored)  # one row each


_CHUNKS = r"""
p as (select doc_id, 'd' || doc_id fonte, lang tipo, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))), lambda x: x <> '') l from documents),
g as (select *, list_reduce(l, lambda s, x: case when s.n > 0 and s.n + length(x) > 240 then {'n': length(x), 'c': list_append(s.c, x)}
  else {'n': s.n + length(x), 'c': case when len(s.c) = 0 then [x] else list_append(s.c[1:-2], case when s.n = 0 and len(s.c) = 0 then x else s.c[-1] || ' ' || x end) end} end, {'n': 0::bigint, 'c': []::varchar[]}).c c from p),
k as (select fonte || '::' || (i - 1) chunk_key, doc_id, fonte, tipo, (i - 1)::int chunk_idx, len(c)::int n_chunks, c[i] texto from g, unnest(range(1, len(c) + 1)) r(i))
"""
_SCORE = "1 - list_sum(list_transform(list_zip({}.embedding, {}.embedding), lambda p: pow(p[1]::double - p[2]::double, 2)))"



def _asked() -> str:
    """The vector of QUESTION, as SQL."""
    row = chunks.hashing_encoder()()([QUESTION])[0]
    return str((row / (row @ row) ** 0.5).astype("float32").tolist())


QUERIES = {
    "f15_t4_explode_chunks": made, "j5_new_chunks": added, "j5_keyed_store": added_keyed, "u2_existing_keys": present, "a8_vector_report": report, "x1_embed": embedded,
    "o2_search_text": by_text, "o3_search_texts": by_texts, "x1_vector_job": vector_job, "o2_top_k": nearest, "p8_filter_min_score": above, "o3_top_k_batch": batch,
}
ORACLE_SQL = {
    "f15_t4_explode_chunks": f"with {_CHUNKS} select * exclude (doc_id) from k",
    "j5_new_chunks": f"with {_CHUNKS} select chunk_key, texto from k where doc_id % 3 > 0",
    "j5_keyed_store": f"with {_CHUNKS} select chunk_key, texto from k where doc_id % 3 > 0",
    "u2_existing_keys": f"with {_CHUNKS} select chunk_key from k where doc_id % 3 = 0",
    "a8_vector_report": f"""with {_CHUNKS} select (select count(*) from documents) linhas, (select count(*) from documents where text <> '') candidatos, count(*) chunks, count(distinct fonte) documentos,
  max(n_chunks) max_chunks, count(*) filter (where doc_id % 3 > 0) adicionados, count(*) filter (where doc_id % 3 = 0) ja_presentes from k""",
    "x1_embed": f"with {_CHUNKS} select chunk_key, 64 size, 1.0::double norm from k",
    "o2_search_text": f"with q as (select {_asked()}::float[] embedding) select e.vec_id, round({_SCORE.format('e', 'q')}, 6) score from embeddings e, q where {_SCORE.format('e', 'q')} >= -5 order by {_SCORE.format('e', 'q')} desc, vec_id limit 10",
    "x1_vector_job": f"""with {_CHUNKS}, c as (select *, doc_id % 7 > 0 w from k)
select (select count(*) from documents) linhas, (select count(*) from documents where doc_id % 7 > 0 and trim(text, ' ') <> '') candidatos, count(*) filter (where w) chunks,
  count(distinct fonte) filter (where w) documentos, coalesce(max(n_chunks) filter (where w), 0) max_chunks, count(*) filter (where w and doc_id % 3 > 0) adicionados,
  count(*) filter (where w and doc_id % 3 = 0) ja_presentes, count(*) filter (where w) guardados, count(distinct chunk_key) filter (where w) chaves from c""",
    "o2_top_k": f"with q as (select embedding from embeddings order by vec_id limit 1) select e.vec_id, round({_SCORE.format('e', 'q')}, 6) score from embeddings e, q order by {_SCORE.format('e', 'q')} desc, vec_id limit 10",
    "p8_filter_min_score": f"with q as (select embedding from embeddings order by vec_id limit 1), s as (select e.vec_id, {_SCORE.format('e', 'q')} x from embeddings e, q) select vec_id, round(x, 6) score from s where x >= -0.5 order by x desc, vec_id limit 100",
    "o3_top_k_batch": f"""with s as (select q.vec_id query_id, e.vec_id, round({_SCORE.format('q', 'e')}, 9) x from embeddings q, embeddings e where q.vec_id % {QUERY_STEP} = 0)
select query_id, vec_id, round(x, 6) score, posicao::int posicao from (select *, row_number() over (partition by query_id order by x desc, vec_id) posicao from s) where posicao <= 5""",
}
