"""The registry job: filings are orders, depositors their line items' suppliers, roots the names of nations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import parties, quality, rows
from lavra.sources.tables import table

#: Years that the gate of the report asks for.
GATE = (1996, 1998)
ROOTS = ["NACION_1", "NATION_2", "NATION_7"]


def _padded(key: str, by: str) -> Column:
    """The key as text, with white space around it in some rows."""
    k = F.col(key).cast("string")
    return F.when(F.col(by) % 3 == 0, F.concat(F.lit("  "), k)).when(F.col(by) % 3 == 1, F.concat(k, F.lit(" \t"))).otherwise(k)


def depositors(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their supplier; accents are put into some names, and every supplier has a tax id."""
    suppliers = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Empresa "), F.replace("n_name", F.lit("NATION"), F.lit("Nàtión")), F.lit("  SA"))).otherwise(F.col("n_name")).alias("depositante"),
        F.concat(F.lit("12.345."), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("cgccpfdepositante"),
    )
    return table(spark, sf, "lineitem").select("l_suppkey", _padded("l_orderkey", "l_linenumber").alias("numero_inpi"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordem")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    ).drop("l_suppkey", "s_suppkey")


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where("s_suppkey % 13 = 0").select(F.concat(F.lit("12345"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("tax_id"))


def content(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        _padded("l_orderkey", "l_partkey").alias("numero_inpi"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordem"),
        F.when(F.col("l_linenumber") > 1, F.col("p_name")).otherwise("nan").alias("titulo"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).alias("resumo"),
    )


def biblio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        _padded("o_orderkey", "o_custkey").alias("numero_inpi"), F.col("o_orderkey").alias("ordem"), F.when(F.col("o_orderkey") % 6 > 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise("None").alias("data_deposito")
    )


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return parties.classify_party(depositors(spark, sf), "depositante", "cgccpfdepositante", crosswalk(spark, sf), ROOTS)


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    return parties.collect_labels(_classified(spark, sf), "numero_inpi", "ordem")


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("instituicoes", F.array_join("instituicoes", "|"))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Titles, abstracts and dates of the network's filings."""
    out = parties.enrich(_filings(spark, sf), content(spark, sf), biblio(spark, sf), "numero_inpi", "ordem")
    return out.select("numero_inpi", "titulo", "resumo", "data_deposito")


def restricted(spark: SparkSession, sf: str) -> DataFrame:
    return parties.restrict_to_network(content(spark, sf), _filings(spark, sf), "numero_inpi").select("numero_inpi", "ordem")


def whole_job(spark: SparkSession, sf: str) -> DataFrame:
    d = parties.extract_registry(depositors(spark, sf), content(spark, sf), biblio(spark, sf), crosswalk(spark, sf), ROOTS)
    return _joined(d).select("numero_inpi", "instituicoes", "ordem", "titulo", "resumo", "data_deposito")


def first_title(spark: SparkSession, sf: str) -> DataFrame:
    trimmed = content(spark, sf).withColumn("numero_inpi", parties.filing_number(F.col("numero_inpi")))
    return rows.first_nonblank(trimmed, "numero_inpi", "titulo", ["ordem"])


def job_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the job: the gate is the verdict on all orders' dates, rejected are line items without a tax."""
    d, x = depositors(spark, sf), crosswalk(spark, sf)
    dated = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    gate = quality.quality_verdict(quality.date_profile(dated, "d", GATE), quality.coverage_by_year(dated, "d", GATE), GATE)
    filings = parties.extract_registry(d, content(spark, sf), biblio(spark, sf), x, ROOTS)
    got = parties.registry_report(d, filings, table(spark, sf, "lineitem").where("l_tax = 0"), x, ROOTS, gate)
    return got.withColumn("cobertura_por_raiz", F.to_json("cobertura_por_raiz")).drop("membros_ausentes", "erro")


_BASE = """
s as (select s_suppkey, case when s_suppkey % 2 = 0 then 'EMPRESA ' || n_name || '  SA' else n_name end folded, '12345' || lpad(s_suppkey::varchar, 9, '0') digits
  from supplier join nation on s_nationkey = n_nationkey),
d as (select l_orderkey::varchar numero_inpi, l_orderkey * 10 + l_linenumber ordem, folded, digits,
  case when s_suppkey % 13 = 0 then 'crosswalk_cnpj' when contains(folded, 'NACION_1') then 'NACION_1' when contains(folded, 'NATION_2') then 'NATION_2' when contains(folded, 'NATION_7') then 'NATION_7' end raiz
  from lineitem join s on l_suppkey = s_suppkey),
k as (select *, case when raiz = 'crosswalk_cnpj' then digits when raiz is not null then folded end rotulo from d),
f as (select numero_inpi, string_agg(rotulo, '|' order by o, rotulo) instituicoes, min(o) ordem from (select numero_inpi, rotulo, min(ordem) o from k where raiz is not null group by all) group by all),
c as (select l_orderkey::varchar numero_inpi, l_orderkey * 10 + l_linenumber ordem, case when l_linenumber > 1 then p_name else 'nan' end titulo, case when l_linenumber % 2 = 0 then p_type end resumo from lineitem join part on l_partkey = p_partkey),
t as (select numero_inpi, arg_min(titulo, (ordem, titulo)) titulo from c where titulo <> 'nan' group by all),
a as (select numero_inpi, arg_min(resumo, (ordem, resumo)) resumo from c where resumo is not null group by all),
e as (select numero_inpi, instituicoes, ordem, coalesce(titulo, '') titulo, coalesce(resumo, '') resumo,
  case when o_orderkey % 6 > 0 then strftime(o_orderdate, '%Y-%m-%d') else '' end data_deposito
  from f left join t using (numero_inpi) left join a using (numero_inpi) join orders on o_orderkey::varchar = numero_inpi)
"""

QUERIES = {
    "p2_classify_party": lambda spark, sf: _classified(spark, sf).select(parties.filing_number(F.col("numero_inpi")).alias("numero_inpi"), "ordem", "raiz", "rotulo"),
    "a1_collect_labels": lambda spark, sf: _joined(_filings(spark, sf)),
    "a2_coverage_by_root": lambda spark, sf: parties.coverage_by_root(_classified(spark, sf), ROOTS),
    "a3_match_counts": lambda spark, sf: parties.match_counts(_classified(spark, sf), "numero_inpi"),
    "j2_j3_enrich": enriched, "j4_restrict_to_network": restricted, "w2_first_nonblank": first_title, "o4_registry_job": whole_job, "o4_registry_report": job_report,
}
ORACLE_SQL = {
    "p2_classify_party": f"with {_BASE} select numero_inpi, ordem, raiz, rotulo from k",
    "a1_collect_labels": f"with {_BASE} select numero_inpi, instituicoes, ordem from f",
    "a2_coverage_by_root": f"with {_BASE} select raiz, count(numero_inpi) n from (values ('NACION_1'), ('NATION_2'), ('NATION_7'), ('crosswalk_cnpj')) r(raiz) left join k using (raiz) group by raiz",
    "a3_match_counts": f"with {_BASE} select count(raiz) casados, count(*) - count(raiz) descartados, count(distinct numero_inpi) filter (where raiz is not null) depositos from k",
    "j2_j3_enrich": f"with {_BASE} select numero_inpi, titulo, resumo, data_deposito from e",
    "j4_restrict_to_network": f"with {_BASE} select numero_inpi, ordem from c where numero_inpi in (select numero_inpi from f)",
    "w2_first_nonblank": f"with {_BASE} select * from t",
    "o4_registry_report": f"""with {_BASE}, g as (select count(distinct year(o_orderdate)) filter (where year(o_orderdate) between 1996 and 1998) = 3
  and avg((year(o_orderdate) between 1996 and 1998)::int) >= 0.1 usable from orders),
r as (select raiz, count(numero_inpi) n from (values ('NACION_1'), ('NATION_2'), ('NATION_7'), ('crosswalk_cnpj')) r(raiz) left join k using (raiz) group by raiz)
select case when usable then 'ok' else 'pendente' end veredito, (select count(*) from f) n_registros_csv, (select count(raiz) from k) n_casados_rede, (select count(*) - count(raiz) from k) n_descartados,
  (select count(*) from lineitem where l_tax = 0) linhas_rejeitadas, (select '{{' || string_agg('"' || raiz || '":' || n, ',' order by raiz) || '}}' from r) cobertura_por_raiz, usable fr1_aceito,
  (select count(*) from supplier where s_suppkey % 13 = 0) > 0 crosswalk_presente, (select count(*) from supplier where s_suppkey % 13 = 0) n_cnpj_validos from g""",
    "o4_registry_job": f"with {_BASE} select * from e order by ordem, numero_inpi",
}
