"""The corpus: both sources in one schema, cleaned, flagged, first wins, counted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.dates import WINDOW, normalize_iso, year_in_window
from lavra.functions.text import clean_html, join_title_abstract, main_label, other_labels
from lavra.operators.rows import dedup_first, project_tolerant
from lavra.sources import files
from lavra.sources.scratch import written

NO_INSTITUTION = "(sem instituicao)"
REGISTRY, NEWS = "inpi", "noticia"


def registry_rows(registry: DataFrame, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Corpus rows of filings (numero_inpi, data_deposito, titulo, resumo, instituicoes joined by |, ordem)."""
    date = normalize_iso(F.col("data_deposito"))
    return registry.select(
        F.trim(F.coalesce("numero_inpi", F.lit(""))).alias("fonte"), F.lit(REGISTRY).alias("tipo"), date.alias("data"), main_label(F.col("instituicoes")).alias("instituicao"),
        join_title_abstract(F.col("titulo"), F.col("resumo")).alias("texto_limpido"), year_in_window(date, window).alias("na_janela"),
        (date == "").alias("data_ausente"), F.lit(False).alias("texto_fallback_titulo"), other_labels(F.col("instituicoes")).alias("instituicoes_aux"), F.col("ordem").cast("long").alias("ordem"),
    )


def news_rows(news: DataFrame, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Corpus rows of items (url, data, titulo, texto, instituicao, ordem); an empty text takes the title."""
    date, text, title = normalize_iso(F.col("data")), clean_html(F.col("texto")), clean_html(F.col("titulo"))
    return news.select(
        F.trim(F.coalesce("url", F.lit(""))).alias("fonte"), F.lit(NEWS).alias("tipo"), date.alias("data"), F.trim(F.coalesce("instituicao", F.lit(""))).alias("instituicao"),
        F.when(text == "", title).otherwise(text).alias("texto_limpido"), year_in_window(date, window).alias("na_janela"),
        (date == "").alias("data_ausente"), (text == "").alias("texto_fallback_titulo"), F.lit("").alias("instituicoes_aux"), F.col("ordem").cast("long").alias("ordem"),
    )


def build_corpus(registry: DataFrame, news: DataFrame, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Both sources, the first row of each (tipo, fonte); rows without a source key are all kept."""
    return dedup_first(registry_rows(registry, window).unionByName(news_rows(news, window)), ["tipo", "fonte"], ["ordem"])


def sort_corpus(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy("tipo", "fonte", "ordem")


def corpus_report(corpus: DataFrame) -> DataFrame:
    """One row of counts. Undated rows are not outside the window: they are counted apart."""
    c = F.col
    return corpus.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(c("na_janela")).alias("n_na_janela"), F.count_if(~c("na_janela") & ~c("data_ausente")).alias("n_fora_janela"),
        F.count_if(c("data_ausente")).alias("n_sem_data"), F.count_if(c("texto_fallback_titulo")).alias("n_fallback_titulo"), F.count_if(c("instituicoes_aux") != "").alias("n_multi_instituicao"),
    )


def count_by_type(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("tipo").agg(F.count(F.lit(1)).alias("n"))


def count_by_institution(corpus: DataFrame) -> DataFrame:
    name = F.when(F.trim(F.coalesce("instituicao", F.lit(""))) == "", NO_INSTITUTION).otherwise(F.col("instituicao"))
    return corpus.groupBy(name.alias("instituicao")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_accounting(rows: DataFrame) -> DataFrame:
    """Rows (tipo, lidas, mantidas, removidas) of corpus rows before first wins: read less removed is kept."""
    per_key = rows.groupBy("tipo", "fonte").agg(F.count(F.lit(1)).alias("k"))
    kept = F.when(F.col("fonte") == "", F.col("k")).otherwise(1)
    return per_key.groupBy("tipo").agg(F.sum("k").alias("lidas"), F.sum(kept).alias("mantidas"), F.sum(F.col("k") - kept).alias("removidas"))


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:
        return False


def _registry_file(spark: SparkSession, path: str) -> DataFrame:
    head = files.sniff_header(spark, path).orderBy("path").first()
    encoding = "UTF-8" if head.encoding == "utf-8-sig" else head.encoding
    # A file may have a column `ordem` of its own.
    read = files.read_table_csv(spark, path, head.columns, head.delimiter, encoding, order="__place")
    return project_tolerant(read, ["numero_inpi", "data_deposito", "titulo", "resumo", "instituicoes", "__place"]).withColumnRenamed("__place", "ordem")


def corpus_from_files(spark: SparkSession, registry_csv: str, news_json: str, out_csv: str, out_report: str, window: tuple[int, int] = WINDOW) -> DataFrame:
    """The corpus job on its files: reads both sources, writes the corpus and its report, and returns the report's row.

    Either source may be several files, each with a header or a list of its own; their names say their order.
    A source that is missing, or that holds no list, is an error in the report, and the other is still built;
    so is a corpus that can't be written. Elements of the list that are no objects are counted by type.
    Columns that the registry lacks are blank. Columns of the report: n_total, n_janela, n_fora_janela,
    n_sem_data, n_inpi, n_noticias (rows read), n_duplicatas_removidas, n_dup_inpi, n_dup_noticias, n_por_tipo,
    n_por_instituicao (maps), n_texto_fallback_titulo, n_multi_instituicoes, erros (array<string>).
    """
    errors = []
    kind = "fonte string, tipo string, data string, instituicao string, texto_limpido string, na_janela boolean, data_ausente boolean, texto_fallback_titulo boolean, instituicoes_aux string, ordem long"
    every = spark.createDataFrame([], kind)
    if _there(spark, registry_csv):
        every = every.unionByName(registry_rows(_registry_file(spark, registry_csv), window))
    else:
        errors.append(f"inpi_csv não encontrado: {registry_csv}")
    if _there(spark, news_json):
        items, wrong = files.read_items_json(spark, news_json, order="ordem")
        every = every.unionByName(news_rows(files.item_fields(items), window))
        # A row for each type of value that JSON has.
        for r in wrong.groupBy(F.col("pos").isNull().alias("whole"), F.regexp_extract("kind", r"^[^<(]*", 0).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy("whole", "kind").collect():
            errors.append(f"noticias_json: formato inesperado (esperada lista, tipo={r['kind']})" if r["whole"] else f"noticias_json: {r['n']} itens ignorados (tipo={r['kind']})")
    else:
        errors.append(f"noticias_json não encontrado: {news_json}")

    every = written(every, "corpus-rows")
    built = written(dedup_first(every, ["tipo", "fonte"], ["ordem"]), "corpus")
    try:
        files.write_corpus(built, out_csv)
    except AnalysisException as e:
        errors.append(f"falha ao gravar CSV: {e.getCondition()}")
    counts = corpus_report(built).select(
        "n_total", F.col("n_na_janela").alias("n_janela"), "n_fora_janela", "n_sem_data", F.col("n_fallback_titulo").alias("n_texto_fallback_titulo"), F.col("n_multi_instituicao").alias("n_multi_instituicoes"),
    )
    as_map = lambda df, name, key: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))
    of = lambda tipo, column: F.coalesce(F.sum(F.when(F.col("tipo") == tipo, F.col(column))), F.lit(0))
    read = duplicate_accounting(every).agg(
        of(REGISTRY, "lidas").alias("n_inpi"), of(NEWS, "lidas").alias("n_noticias"), F.coalesce(F.sum("removidas"), F.lit(0)).alias("n_duplicatas_removidas"),
        of(REGISTRY, "removidas").alias("n_dup_inpi"), of(NEWS, "removidas").alias("n_dup_noticias"),
    )
    # One row each; the maps have an entry for each type, and for each institution.
    whole = counts.join(read).join(as_map(count_by_type(built), "n_por_tipo", "tipo")).join(as_map(count_by_institution(built), "n_por_instituicao", "instituicao"))
    report = written(whole.withColumn("erros", F.array(*map(F.lit, errors)).cast("array<string>")), "corpus-report")
    files.write_report(report, out_report)
    return report
