"""The corpus job and its parts over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.operators import corpus, rows
from lavra.sources.scratch import shared_folder
from lavra.sources.tables import table

WINDOW = (1996, 1998)
#: Ids that a list of the corpus job takes its objects from.
NEWS_IDS = 5000


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as filings: four rows share a number, some have none or no date."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("BR"), (k - k % 4).cast("string"))).alias("numero_inpi"),
        F.when(k % 7 > 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("data_deposito"),
        F.concat(F.lit("<b>Order "), F.col("o_orderpriority"), F.lit("</b>")).alias("titulo"), F.col("o_orderstatus").alias("resumo"),
        F.concat_ws("|", F.concat(F.lit("inst"), (k % 3).cast("string")), F.when(k % 5 == 0, "other")).alias("instituicoes"), k.alias("ordem"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items, five of them at one address."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.when(k % 11 == 0, None).otherwise(F.concat(F.lit("http://x/"), (k - k % 5).cast("string"))).alias("url"),
        F.when(k % 3 > 0, F.concat((F.lit(1994) + k % 6).cast("string"), F.lit("-06-01T10:00:00Z"))).alias("data"),
        F.concat(F.lit("Title  of "), k.cast("string")).alias("titulo"), F.when(k % 4 > 0, F.col("text")).alias("texto"), F.col("source").alias("instituicao"), k.alias("ordem"),
    )


def _built(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.build_corpus(registry(spark, sf), news(spark, sf), WINDOW)


def _all_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.registry_rows(registry(spark, sf), WINDOW).unionByName(corpus.news_rows(news(spark, sf), WINDOW))


def job_on_files(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the job on files of both sources: CSV files and JSON lists that Spark has written, in order."""
    csv, lists, out = (shared_folder(spark, n) for n in ("registry-file", "news-file", "corpus-job"))
    registry(spark, sf).orderBy("ordem").write.option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').csv(csv)
    part = F.lpad(F.floor(F.col("ordem") / NEWS_IDS).cast("string"), 12, "0")
    objects = news(spark, sf).select(part.alias("part"), "ordem", F.to_json(F.struct("url", "data", "titulo", "texto", "instituicao")).alias("value"))
    # A list over the lines of each file: only its first line opens it and only its last closes it. No join stands between
    # the window and the files, as the planner may then deal one part to several tasks, or drop the order.
    in_part = Window.partitionBy("part").orderBy("ordem")
    begins, ends = F.lag("ordem").over(in_part).isNull(), F.lead("ordem").over(in_part).isNull()
    framed = objects.select("part", "ordem", F.concat(F.when(begins, "[").otherwise(","), "value", F.when(ends, "]").otherwise("")).alias("value"))
    framed.sortWithinPartitions("part", "ordem").select("part", "value").write.partitionBy("part").text(lists)
    got = corpus.corpus_from_files(spark, csv, lists, f"{out}/corpus", f"{out}/report", WINDOW)
    return got.withColumns({c: F.to_json(c) for c in ("n_por_tipo", "n_por_instituicao", "erros")})


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rows.select_candidates(_built(spark, sf), "na_janela", "texto_limpido").select("tipo", "fonte", "ordem")


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return rows.exclusion_counts(_built(spark, sf), "na_janela", "texto_limpido")


def flagged_window(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"))
    return rows.flag_window(d, "iso", WINDOW)


def flagged_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rows.flag_missing(news(spark, sf), "data", "texto", "titulo").select("ordem", "texto", "data_ausente", "texto_fallback_titulo")


def tolerant(spark: SparkSession, sf: str) -> DataFrame:
    return rows.project_tolerant(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_absent"])


def drift(spark: SparkSession, sf: str) -> DataFrame:
    real = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    d = rows.schema_drift(real.columns, ["s_name", "s_remark", "s_suppkey"], real)
    return d.select(*(F.array_join(F.array_sort(c), ",").alias(c) for c in ("present", "absent", "extra")), "schema_ok")


def by_name(spark: SparkSession, sf: str) -> DataFrame:
    return rows.filter_by_name(table(spark, sf, "customer"), "c_name", "MER#00000001").select("c_custkey", "c_name")


def last_event(spark: SparkSession, sf: str) -> DataFrame:
    return rows.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


_ROWS = r"""
r as (select case when o_orderkey % 10 = 0 then '' else 'BR' || (o_orderkey - o_orderkey % 4) end fonte, 'inpi' tipo,
  case when o_orderkey % 7 > 0 then strftime(o_orderdate, '%Y-%m-%d') else '' end as data, 'inst' || (o_orderkey % 3) instituicao,
  'Order ' || o_orderpriority || ' ' || o_orderstatus texto_limpido, o_orderkey % 7 > 0 and year(o_orderdate) between 1996 and 1998 na_janela,
  o_orderkey % 7 = 0 data_ausente, false texto_fallback_titulo, case when o_orderkey % 5 = 0 then 'other' else '' end instituicoes_aux, o_orderkey ordem from orders),
n as (select case when doc_id % 11 = 0 then '' else 'http://x/' || (doc_id - doc_id % 5) end fonte, 'noticia' tipo,
  case when doc_id % 3 > 0 then (1994 + doc_id % 6) || '-06-01' else '' end as data, source instituicao,
  case when doc_id % 4 > 0 and trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) <> '' then trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) else 'Title of ' || doc_id end texto_limpido,
  doc_id % 3 > 0 and 1994 + doc_id % 6 between 1996 and 1998 na_janela, doc_id % 3 = 0 data_ausente,
  doc_id % 4 = 0 or trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) = '' texto_fallback_titulo, '' instituicoes_aux, doc_id ordem from documents),
u as (select * from r union all select * from n),
c as (select * exclude (k) from (select *, row_number() over (partition by tipo, fonte order by ordem) k from u) where k = 1 or fonte = '')
"""

QUERIES = {
    "u1_union_sources": _all_rows,
    "w1_dedup_first": _built,
    "o1_sort_corpus": lambda spark, sf: corpus.sort_corpus(_built(spark, sf)).select("tipo", "fonte", "ordem"),
    "a4_corpus_report": lambda spark, sf: corpus.corpus_report(_built(spark, sf)),
    "a5_count_by_type": lambda spark, sf: corpus.count_by_type(_built(spark, sf)),
    "a6_count_by_institution": lambda spark, sf: corpus.count_by_institution(_built(spark, sf)),
    "a7_duplicate_accounting": lambda spark, sf: corpus.duplicate_accounting(_all_rows(spark, sf)),
    "p1_project_tolerant": tolerant, "p3_flag_window": flagged_window, "p4_flag_missing": flagged_missing, "p5_select_candidates": candidates, "p5_exclusion_counts": exclusions,
    "x2_corpus_files": job_on_files, "p6_filter_by_name": by_name, "q2_schema_drift": drift, "w5_last_wins": last_event,
}
ORACLE_SQL = {
    "u1_union_sources": f"with {_ROWS} select * from u",
    "w1_dedup_first": f"with {_ROWS} select * from c",
    "o1_sort_corpus": f"with {_ROWS} select tipo, fonte, ordem from c order by all",
    "a4_corpus_report": f"""with {_ROWS} select count(*) n_total, count(*) filter (where na_janela) n_na_janela, count(*) filter (where not na_janela and not data_ausente) n_fora_janela,
  count(*) filter (where data_ausente) n_sem_data, count(*) filter (where texto_fallback_titulo) n_fallback_titulo, count(*) filter (where instituicoes_aux <> '') n_multi_instituicao from c""",
    "a5_count_by_type": f"with {_ROWS} select tipo, count(*) n from c group by tipo",
    "a6_count_by_institution": f"with {_ROWS} select instituicao, count(*) n from c group by instituicao",
    "a7_duplicate_accounting": f"""with {_ROWS}, k as (select tipo, count(*) mantidas from c group by tipo), l as (select tipo, count(*) lidas from u group by tipo)
select tipo, lidas, mantidas, lidas - mantidas removidas from l join k using (tipo)""",
    "x2_corpus_files": f"""with {_ROWS}, t as (select '{{' || string_agg('"' || tipo || '":' || n, ',' order by tipo) || '}}' j from (select tipo, count(*) n from c group by tipo)),
i as (select '{{' || string_agg('"' || instituicao || '":' || n, ',' order by instituicao) || '}}' j from (select instituicao, count(*) n from c group by instituicao)),
d as (select (select count(*) from r) - (select count(*) from c where tipo = 'inpi') a, (select count(*) from n) - (select count(*) from c where tipo = 'noticia') b)
select count(*) n_total, count(*) filter (where na_janela) n_janela, count(*) filter (where not na_janela and not data_ausente) n_fora_janela, count(*) filter (where data_ausente) n_sem_data,
  count(*) filter (where texto_fallback_titulo) n_texto_fallback_titulo, count(*) filter (where instituicoes_aux <> '') n_multi_instituicoes, (select count(*) from r) n_inpi, (select count(*) from n) n_noticias,
  (select a + b from d) n_duplicatas_removidas, (select a from d) n_dup_inpi, (select b from d) n_dup_noticias, (select j from t) n_por_tipo, (select j from i) n_por_instituicao, '[]' erros from c""",
    "p1_project_tolerant": "select c_custkey, c_name, '' c_absent from customer",
    "p3_flag_window": """select o_orderkey, iso, year(iso::date)::int ano, coalesce(year(iso::date) between 1996 and 1998, false) na_janela
from (select o_orderkey, case when o_orderkey % 7 > 0 then strftime(o_orderdate, '%Y-%m-%d') end iso from orders)""",
    "p4_flag_missing": f"with {_ROWS} select ordem, texto_limpido texto, data_ausente, texto_fallback_titulo from n",
    "p5_select_candidates": f"with {_ROWS} select tipo, fonte, ordem from c where na_janela and texto_limpido <> ''",
    "p5_exclusion_counts": f"with {_ROWS} select count(*) filter (where na_janela and texto_limpido <> '') candidatos, count(*) filter (where not na_janela) fora_janela, count(*) filter (where na_janela and texto_limpido = '') texto_vazio from c",
    "p6_filter_by_name": "select c_custkey, c_name from customer where contains(lower(c_name), 'mer#00000001')",
    "q2_schema_drift": "select 's_name,s_suppkey' present, 's_remark' absent, 's_nationkey' extra, false schema_ok from supplier limit 1",
    "w5_last_wins": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) k from events) where k = 1",
}
