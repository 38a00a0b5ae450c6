"""Chunks of documents and the table of their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.chunking import chunk_key, pack_chunks, split_paragraphs
from lavra.functions.vectors import l2_score
from lavra.operators.rows import rank_top_k, select_candidates
from lavra.sources.files import append_vectors
from lavra.sources.keyed import KeyedStore
from lavra.sources.scratch import written

#: Queries whose scores with a block of the store are held at once.
SLICE = 256
#: Centres of cells in a search, at most.
PIVOTS = 64


def explode_chunks(corpus: DataFrame, source: str = "fonte", text: str = "texto", tokens: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (chunk_key, source, carried columns, chunk_idx, n_chunks, texto), one per chunk; no shuffle."""
    parts = corpus.select(source, *carry, split_paragraphs(F.col(text)).alias("_parts"))
    packed = parts.select(source, *carry, pack_chunks(F.col("_parts"), tokens).alias("_chunks"))
    # The planner puts filters before a generator and makes chunks anew there, paragraphs once for each chunk: its own, unless it is outer, and a
    # user's on n_chunks, unless that comes out of the generator.
    numbered = F.transform("_chunks", lambda c, i: F.struct(i.alias("chunk_idx"), F.size("_chunks").alias("n_chunks"), c.alias("texto")))
    each = packed.select(source, *carry, F.inline_outer(numbered).alias("chunk_idx", "n_chunks", "texto")).where("chunk_idx is not null")
    return each.select(chunk_key(F.col(source), F.col("chunk_idx")).alias("chunk_key"), source, *carry, "chunk_idx", "n_chunks", "texto")


def existing_keys(ids: DataFrame, store: DataFrame, key: str = "chunk_key") -> DataFrame:
    """The ids that the store has."""
    return ids.select(key).join(store.select(key), key, "left_semi").distinct()


def new_chunks(chunks: DataFrame, store: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Chunks whose key is not stored; of chunks that share a key the smallest. Stored texts are never updated. Null keys are one key."""
    # Nulls are told by a column of their own, so that both steps are dealt by the same keys and texts travel once.
    by = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(key).isNull().alias("_none")]
    unique = chunks.groupBy(*by).agg(F.min(F.struct(*chunks.columns)).alias("_row"))
    return unique.join(store.select(*by).distinct(), ["_key", "_none"], "left_anti").select("_row.*")


def embed(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "texto", out: str = "embedding") -> DataFrame:
    """chunks with unit vectors. `encoder` builds, once for each worker, what maps texts to a matrix.

    A matrix of any other number of rows than texts fails the job.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in series:
            matrix = np.asarray(encode(texts.fillna("").tolist()), dtype=np.float64)
            if len(matrix) != len(texts):
                raise ValueError(f"the encoder gave {len(matrix)} vectors for {len(texts)} texts")
            norms = np.linalg.norm(matrix, axis=1, keepdims=True) if len(matrix) else np.ones((0, 1))
            yield pd.Series(list((matrix / np.where(norms > 0, norms, 1)).astype(np.float32)))

    return chunks.withColumn(out, F.pandas_udf(run, T.ArrayType(T.FloatType()))(F.col(text)))


def hashing_encoder(size: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder without a model: counts of words by hash, the same on every machine."""

    def build():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            matrix = np.zeros((len(texts), size))
            for row, text in zip(matrix, texts):
                row[:] = np.bincount([zlib.crc32(word.encode()) % size for word in text.lower().split()], minlength=size)
            return matrix

        return encode

    return build


def vector_report(corpus: DataFrame, candidates: DataFrame, chunks: DataFrame, added: DataFrame, source: str = "fonte") -> DataFrame:
    """One row: corpus rows, candidates, chunks made, added and present, documents, most chunks of a document."""
    made = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(source).alias("documentos"), F.coalesce(F.max("n_chunks"), F.lit(0)).alias("max_chunks"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    whole = n(corpus, "linhas").join(n(candidates, "candidatos")).join(made).join(n(added, "adicionados"))
    return whole.withColumn("ja_presentes", F.col("chunks") - F.col("adicionados"))


def top_k(vectors: DataFrame, query: list[float], k: int, min_score: float | None = None, key: str = "chunk_key", vector: str = "embedding") -> DataFrame:
    """The k nearest rows to one query with `score` = 1 less the squared distance, best first, ties by key.

    A k that is no whole number above 0, an empty query and an empty store give no rows. Each task keeps
    its best k; nothing is sorted as a whole.
    """
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0 or not query:
        return vectors.withColumn("score", F.lit(0.0)).limit(0)
    scored = vectors.withColumn("score", l2_score(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def index_documents(
    corpus: DataFrame, path: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], store: DataFrame | None = None, source: str = "fonte", text: str = "texto", window_col: str = "na_janela",
    tokens: int | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """The vector job: candidates in chunks, those not in the store encoded and added at `path`; returns vector_report's row.

    store is what an earlier run left at `path`, None in the first run. Chunks that it has are neither
    encoded nor written again. New vectors are written once in the shared folder before they are added,
    so a task that is run again encodes alone and adds nothing twice.
    """
    candidates = select_candidates(corpus, window_col, text)
    made = written(explode_chunks(candidates, source, text, tokens, carry), "chunks")
    fresh = written(embed(new_chunks(made, made.limit(0) if store is None else store), encoder), "vectors")
    append_vectors(fresh, path)
    return vector_report(corpus, candidates, made, fresh, source)


def vector_store(spark: SparkSession, path: str, carry: tuple[T.StructField, ...] = (), source: str = "fonte", bits: int = 6) -> KeyedStore:
    """The store of chunks and vectors at `path` that index_into fills; `carry` are the fields of carried columns."""
    text = T.StringType()
    fields = [T.StructField("chunk_key", text), T.StructField(source, text), *carry, T.StructField("chunk_idx", T.IntegerType()), T.StructField("n_chunks", T.IntegerType()), T.StructField("texto", text), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    return KeyedStore(spark, path, T.StructType(fields), "chunk_key", bits)


def index_into(
    corpus: DataFrame, store: KeyedStore, encoder: Callable[[], Callable[[list[str]], np.ndarray]], source: str = "fonte", text: str = "texto", window_col: str = "na_janela", tokens: int | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """index_documents on a keyed store: of what is stored only the files that may hold one of the chunks are opened.

    The report's row is the same. A run that fails leaves the store as it was.
    """
    candidates = select_candidates(corpus, window_col, text)
    made = written(explode_chunks(candidates, source, text, tokens, carry), "chunks")
    fresh = written(embed(new_chunks(store.missing(made), made.limit(0)), encoder), "vectors")
    store.append(fresh)
    return vector_report(corpus, candidates, made, fresh, source)


def search_text(vectors: DataFrame, question: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], k: int = 5, min_score: float | None = None, key: str = "chunk_key", vector: str = "embedding") -> DataFrame:
    """top_k of a text: the k nearest rows of at least min_score, best first; text columns that are null become empty.

    A question that is no text or blank, a k that is no whole number above 0 and a min_score that is no
    number give no rows, and nothing is encoded then.
    """
    good = isinstance(question, str) and question.strip() and (min_score is None or isinstance(min_score, (int, float)))
    query: list[float] = []
    if good and isinstance(k, int) and k > 0:
        row = np.asarray(encoder()([question]), dtype=np.float64)[0]
        norm = np.linalg.norm(row)
        query = (row / (norm if norm > 0 else 1)).astype(np.float32).tolist()
    found = top_k(vectors, query, k, min_score if query else None, key, vector)
    return found.na.fill("")


def search_texts(vectors: DataFrame, questions: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], k: int = 5, min_score: float | None = None, key: str = "chunk_key", vector: str = "embedding", query_id: str = "query_id", text: str = "texto") -> DataFrame:
    """top_k_batch of the texts of questions (query_id, texto); null and blank ones get no rows."""
    asked = questions.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(query_id, text)
    encoded = written(embed(asked, encoder, text, vector).select(query_id, vector), "questions")
    return top_k_batch(vectors, encoded, k, min_score, key, vector, query_id)


def _centres(rows: DataFrame, name: str, vector: str, block: int) -> np.ndarray:
    """Vectors that cells lie around: those of least hash, one for each `block` rows, and PIVOTS at most."""
    most = max(1, min(PIVOTS, rows.count() // block))
    found = rows.orderBy(F.xxhash64(name), name).limit(most).select(F.col(vector).cast("array<double>").alias("v")).collect()
    return np.array([r.v for r in found], np.float64)


def _in_cells(rows: DataFrame, name: str, vector: str, centres: np.ndarray, block: int) -> DataFrame:
    """Rows (b, cell, low, high, ids, vs): blocks of at most `block` rows, written.

    A block's rows lie in the cell of their nearest centre, at distances of low to high from it. Rows are sorted
    by cell and distance over all partitions, so no cell, however full, meets in one task.
    """
    of_id = rows.schema[name].dataType
    place = T.StructType([T.StructField("id", of_id), T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())])

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms = (centres * centres).sum(1)
        for frame in frames:
            if len(frame):
                v = np.stack(frame["v"]).astype(np.float64)
                cell = np.argmin(norms[None, :] - 2 * v @ centres.T, axis=1)
                d = np.sqrt(((v - centres[cell]) ** 2).sum(1))
                yield pd.DataFrame({"id": frame["id"], "v": frame["v"], "cell": cell.astype(np.int32), "d": d})

    placed = written(rows.select(F.col(name).alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInPandas(nearest, place), "placed")
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("ids", T.ArrayType(of_id)), T.StructField("vs", T.ArrayType(T.FloatType()))])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def rows_of(part: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            """The blocks that are full, or end with their cell, and what is left for the next."""
            out = []
            while len(part):
                size = min(block, int(np.searchsorted(part["cell"], part["cell"].iloc[0], side="right")))
                if size == len(part) and size < block and not last:
                    break
                one, part = part.iloc[:size], part.iloc[size:]
                out.append((int(one["cell"].iloc[0]), one["d"].min(), one["d"].max(), one["id"].tolist(), np.concatenate(one["v"].tolist())))
            return pd.DataFrame(out, columns=kind.names), part

        for frame in frames:
            full, held = rows_of(frame if held is None else pd.concat([held, frame]), False)
            if len(full):
                yield full
        if held is not None and len(held):
            yield rows_of(held, True)[0]

    ordered = placed.repartitionByRange("cell", "d", "id").sortWithinPartitions("cell", "d", "id").mapInPandas(cut, kind)
    return written(ordered.select(F.monotonically_increasing_id().alias("b"), "*"), "blocks")


def _scores(qi: pa.ListScalar, qv: pa.ListScalar, vi: pa.ListScalar, vv: pa.ListScalar) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, scores with the block vv) of SLICE queries of the block qv after another."""
    a, b = (v.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(i), -1) for i, v in ((qi, qv), (vi, vv)))
    for at in range(0, len(a), SLICE):
        part = a[at : at + SLICE]
        yield at, 1 - ((part * part).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * part @ b.T)


def block_pairs(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None, key: str, vector: str, query_id: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, blocks of queries, blocks of the store): pairs (qb, vb) of blocks that may hold one of a query's best k.

    The best k of the block that lies nearest to a query's own bound how far its best k lie. By the triangle
    inequality no row of another block is nearer than the centres' distance less the rows' distances from
    them; blocks beyond the bound are left out. If nothing is, all pairs stay.
    """
    whole = lambda df, name: df.where(F.size(vector) > 0).select(name, vector)
    centres = _centres(whole(vectors, key), key, vector, block)
    store = _in_cells(whole(vectors, key), key, vector, centres, block)
    asked = _in_cells(whole(queries, query_id), query_id, vector, centres, block)
    of_store = store.select(F.col("b").alias("vb"), F.col("cell").alias("vcell"), F.col("low").alias("vlow"), F.col("high").alias("vhigh"), F.size("ids").alias("n"))
    of_asked = asked.select(F.col("b").alias("qb"), "cell", "low", "high")
    # From a block's middle to the block of its cell whose rows lie at about the same distance; full ones first.
    off = F.abs(F.col("low") + F.col("high") - F.col("vlow") - F.col("vhigh"))
    home = of_asked.join(of_store, F.col("cell") == F.col("vcell")).groupBy("qb").agg(F.min_by("vb", F.struct(F.col("n") < k, off, "vb")).alias("vb"))
    vs = store.select(F.col("b").alias("vb"), F.col("ids").alias("vi"), F.col("vs").alias("vv"))
    qs = asked.select(F.col("b").alias("qb"), F.col("ids").alias("qi"), F.col("vs").alias("qv"))
    far = float("inf") if min_score is None else max(0.0, 1 - min_score)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for qb, qi, qv, vi, vv in zip(*(batch.column(c) for c in ("qb", "qi", "qv", "vi", "vv"))):
                worst = max(float((1 - np.partition(s, -k, axis=1)[:, -k]).max()) for _, s in _scores(qi, qv, vi, vv)) if len(vi) >= k else float("inf")
                out.append((qb.as_py(), min(worst, far)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([r for _, r in out], pa.float64())], names=["qb", "reach2"])

    reach = written(qs.join(home, "qb").join(vs, "vb").mapInArrow(bound, "qb long, reach2 double"), "reach")
    gaps = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2), 0))
    apart = vectors.sparkSession.createDataFrame([(i, j, float(gaps[i, j])) for i in range(len(centres)) for j in range(len(centres))], "cell int, vcell int, gap double")
    least = F.greatest(F.lit(0.0), F.col("gap") - F.col("high") - F.col("vhigh"), F.col("low") - F.col("gap") - F.col("vhigh"), F.col("vlow") - F.col("gap") - F.col("high"))
    # Scores are rounded to nine places before they are ranked.
    near = least * least <= F.col("reach2") + (F.col("reach2") + 1) * 1e-8
    pairs = of_asked.join(reach, "qb").join(apart, "cell").join(of_store, "vcell").where(near).select("qb", "vb")
    return pairs, qs, vs


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, key: str = "chunk_key", vector: str = "embedding", query_id: str = "query_id", block: int = 4096) -> DataFrame:
    """Rows (query_id, key, score, posicao): the k nearest of every query, exactly; ties by key.

    Both sides lie in cells around a few rows of the store, cut into blocks. Only pairs of blocks that can be
    near enough meet (see block_pairs); vectors without any clusters may leave all of them. A task multiplies
    two blocks and keeps each query's best k, so k rows for each query and block are ranked, never all pairs.
    All vectors have one size; queries without a vector get no rows.
    """
    names = [queries.schema[query_id].dataType, vectors.schema[key].dataType]
    fields = T.StructType([T.StructField(query_id, names[0]), T.StructField(key, names[1]), T.StructField("score", T.DoubleType())])
    nothing = queries.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("posicao", T.IntegerType())]))
    if not isinstance(k, int) or k <= 0:
        return nothing
    if vectors.where(F.size(vector) > 0).isEmpty():
        return nothing
    pairs, qs, vs = block_pairs(vectors, queries, k, min_score, key, vector, query_id, block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, vi, vv in zip(*batch.columns):
                asked, ids = (i.values.to_numpy(zero_copy_only=False) for i in (qi, vi))
                order = np.argsort(ids, kind="stable")
                for at, scores in _scores(qi, qv, vi, vv):
                    scores = np.round(scores[:, order], 9)
                    # By rounded score and then key, as they are ranked afterwards.
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    columns = np.repeat(asked[at : at + SLICE], top.shape[1]), ids[order][top].ravel(), np.take_along_axis(scores, top, 1).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (qi.values.type, vi.values.type, pa.float64()))], names=[query_id, key, "score"])

    near = pairs.join(qs, "qb").join(vs, "vb").select("qi", "qv", "vi", "vv").mapInArrow(best, fields)
    if min_score is not None:
        near = near.where(F.col("score") >= min_score)
    return rank_top_k(near, query_id, "score", key, k)
