import json

import pytest
from pyspark.sql import functions as F

from lavra.operators import corpus


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "r.csv").write_text('﻿numero_inpi;titulo;instituicoes;data_deposito\nBR1;"a; ""b""\nc";X|Y;01/02/2020\n BR1 ;again;X;01/02/2020\n;none;;\n', encoding="utf-8")
    items = [{"url": "http://n/1", "titulo": "t", "data": "2021-03-04"}, "text", 5, {"url": "http://n/1", "titulo": "u", "texto": "x"}, {"titulo": "no url", "instituicao": "IF"}]
    (tmp_path / "n.json").write_text(json.dumps(items))
    return tmp_path


def run(spark, at, registry="r.csv", news="n.json", out="out"):
    return corpus.corpus_from_files(spark, str(at / registry), str(at / news), str(at / out / "c"), str(at / out / "j"), (2019, 2026)).first()


def test_job_on_files(spark, sources):
    got = run(spark, sources)
    assert (got.n_total, got.n_inpi, got.n_noticias, got.n_dup_inpi, got.n_dup_noticias, got.n_duplicatas_removidas) == (4, 3, 3, 1, 1, 2)
    assert (got.n_janela, got.n_fora_janela, got.n_sem_data, got.n_multi_instituicoes) == (2, 0, 2, 1)
    assert got.n_por_tipo == {"inpi": 2, "noticia": 2} and got.n_por_instituicao == {"X": 1, "IF": 1, "(sem instituicao)": 2}
    assert got.erros == ["noticias_json: 1 itens ignorados (tipo=BIGINT)", "noticias_json: 1 itens ignorados (tipo=STRING)"]
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(sources / "out/c"))
    assert back.count() == 4 and back.where(F.col("fonte") == "BR1").first().texto_limpido.startswith('a; "b" c')
    report = json.loads(next((sources / "out/j").glob("part-*")).read_text())
    assert report["n_total"] == 4 and len(report["erros"]) == 2


def test_a_missing_or_malformed_source_is_reported_and_the_other_built(spark, sources):
    got = run(spark, sources, registry="absent.csv", out="a")
    assert (got.n_total, got.n_inpi, got.n_noticias) == (2, 0, 3) and got.erros[0].startswith("inpi_csv não encontrado")
    (sources / "o.json").write_text('{"a": 1}')
    got = run(spark, sources, news="o.json", out="b")
    assert (got.n_total, got.n_noticias) == (2, 0) and got.erros == ["noticias_json: formato inesperado (esperada lista, tipo=OBJECT)"]
    got = run(spark, sources, registry="x", news="y", out="c")
    assert got.n_total == 0 and len(got.erros) == 2 and got.n_por_tipo == {}
    # The corpus is not written over: the report says so.
    assert any(e.startswith("falha ao gravar CSV") for e in corpus.corpus_from_files(spark, str(sources / "r.csv"), str(sources / "n.json"), str(sources / "a/c"), str(sources / "d/j")).first().erros)


def test_job_on_files_whatever_the_order_of_the_tables(spark, tmp_path, monkeypatch):
    from lavra.plans import corpus as plan

    monkeypatch.setattr(plan, "NEWS_IDS", 7)
    for k, ids in enumerate([(30, 45), (15, 30), (0, 15)]):
        n = spark.range(*ids, numPartitions=1)
        docs = n.select(F.col("id").alias("doc_id"), F.repeat(F.lit("wort "), (45 - F.col("id")).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source"))
        docs.write.mode("append" if k else "overwrite").parquet(str(tmp_path / "documents.parquet"))
        orders = n.select(F.col("id").alias("o_orderkey"), F.expr("date'1996-01-01' + cast(id * 31 as int)").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"))
        orders.write.mode("append" if k else "overwrite").parquet(str(tmp_path / "orders.parquet"))
    got = plan.job_on_files(spark, str(tmp_path)).first()
    assert (got.n_inpi, got.n_noticias, got.erros) == (45, 45, "[]")
    want = corpus.corpus_report(plan._built(spark, str(tmp_path))).first()
    assert [got[n] for n in ("n_total", "n_janela", "n_fora_janela", "n_sem_data", "n_texto_fallback_titulo")] == list(want)[:5]
