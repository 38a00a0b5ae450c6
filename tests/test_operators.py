import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavra.operators import chunks, corpus, items, parties, quality, robots, rows
from lavra.sources import files

ROOTS = ["ESCOLA TECNICA DE", "CENTRO NAUTICO DE PESQ", "LICEU DAS ARTES"]


def dated(spark, dates):
    return spark.createDataFrame([(d,) for d in dates], "d string")


def verdict(spark, dates):
    df = dated(spark, dates)
    p = quality.date_profile(df, "d")
    return p.first(), quality.quality_verdict(p, quality.coverage_by_year(df, "d")).first().usable


def test_date_profile_verdicts(spark):
    good = [f"{y}-04-09" for y in range(2019, 2027) for _ in range(6)] + ["1987-10-11"] * 150 + ["2031-02-03"]
    p, usable = verdict(spark, good)
    assert usable and (p.min_date, p.max_date, p.min_in_window, p.max_in_window) == ("1987-10-11", "2031-02-03", "2019-04-09", "2026-04-09")
    assert not verdict(spark, [f"{y}-04-09" for y in range(2019, 2026) for _ in range(6)] + ["1987-10-11"] * 80)[1]
    assert not verdict(spark, [f"{y}-04-09" for y in range(2019, 2027)] + ["1987-10-11"] * 900)[1]
    p, usable = verdict(spark, ["0033-05-06", "1050-10-10", "2020-09-14", "sem data", None, ""])
    assert (p.n_parseable, p.n_implausible, p.min_date, p.n_nonblank, usable) == (3, 2, "0033-05-06", 4, False)
    assert verdict(spark, [])[0].n_rows == 0


def test_registry_job(spark):
    dep = [
        ("PX401", "ESCOLA TECNICA DE OLARIA", ""), ("PX402", "PADARIA DO PORTO", ""), ("PX403", "Centro Náutico de Pesquisa da Foz", None),
        ("PX404", "Liceu das Ártes", ""), ("PX404", "Oficina do Cais", ""), ("PX404", "ESCOLA TECNICA DE BARRO", ""), ("PX405", None, "98.765.432/0001-10"), ("PX404", "LICEU DAS ARTES", ""),
    ]
    depositors = spark.createDataFrame([(*r, i) for i, r in enumerate(dep)], "numero_inpi string, depositante string, cgccpfdepositante string, ordem int").repartition(3)
    content = spark.createDataFrame([("PX401", "nan", None, 0), ("PX401", "Second", "abs", 1), ("PX402", "other", "x", 2), ("PX403", " ", "nan", 3)], "numero_inpi string, titulo string, resumo string, ordem int")
    biblio = spark.createDataFrame([("PX401", " None ", 0), ("PX401", " 2021-07-08 ", 1), ("PX401", "2022-07-08", 2)], "numero_inpi string, data_deposito string, ordem int")
    xw = spark.createDataFrame([("98765432000110",)], "tax_id string")
    got = [tuple(r) for r in parties.extract_registry(depositors, content, biblio, xw, ROOTS).select("numero_inpi", "instituicoes", "titulo", "resumo", "data_deposito").collect()]
    assert got == [
        ("PX401", ["ESCOLA TECNICA DE OLARIA"], "Second", "abs", "2021-07-08"),
        ("PX403", ["CENTRO NAUTICO DE PESQUISA DA FOZ"], " ", "", ""),
        ("PX404", ["LICEU DAS ARTES", "ESCOLA TECNICA DE BARRO"], "", "", ""),
        ("PX405", ["98765432000110"], "", "", ""),
    ]
    classified = parties.classify_party(depositors, "depositante", "cgccpfdepositante", xw, ROOTS)
    assert tuple(parties.match_counts(classified, "numero_inpi").first()) == (6, 2, 4)
    assert dict(map(tuple, parties.coverage_by_root(classified, [*ROOTS, "NONE"]).collect())) == {ROOTS[0]: 2, ROOTS[1]: 1, ROOTS[2]: 2, "NONE": 0, "crosswalk_cnpj": 1}


def test_corpus_job(spark):
    registry = spark.createDataFrame(
        [("BR1", "2023-01-01", "t", "r", "X|Y", 0), ("BR1", "2015-01-01", "again", "", "X", 1), ("BR2", "2015-08-05", "", "", "", 2), ("", None, "a", "", "", 3), ("", "", "b", "", "", 4)],
        "numero_inpi string, data_deposito string, titulo string, resumo string, instituicoes string, ordem int",
    )
    news = spark.createDataFrame([("http://n/1", "17/02/2022", "Feira de barcos reabre", "", "IF", 0), ("http://n/1", None, "x", "y", "IF", 1)], "url string, data string, titulo string, texto string, instituicao string, ordem int")
    built = corpus.build_corpus(registry, news)
    report = corpus.corpus_report(built).first()
    assert tuple(report) == (5, 2, 1, 2, 1, 1)
    n = built.where("tipo = 'noticia'").first()
    assert (n.texto_limpido, n.texto_fallback_titulo, n.data, n.na_janela) == ("Feira de barcos reabre", True, "2022-02-17", True)
    everything = corpus.registry_rows(registry).unionByName(corpus.news_rows(news))
    assert {tuple(r) for r in corpus.duplicate_accounting(everything).collect()} == {("inpi", 5, 4, 1), ("noticia", 2, 1, 1)}
    assert dict(map(tuple, corpus.count_by_institution(built).collect())) == {"X": 1, "(sem instituicao)": 3, "IF": 1}
    assert corpus.build_corpus(registry.limit(0), news.limit(0)).count() == 0


def test_merge_and_last_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "key string, ordem int, v string")
    new = spark.createDataFrame([("a", 9, "no"), ("b", 2, "later"), ("b", 1, "first")], "key string, ordem int, v string")
    assert {tuple(r) for r in rows.merge_items(old, new, "key", "ordem").collect()} == {("a", 2, "y", "existente"), ("b", 1, "first", "novo")}


def test_chunk_store_is_idempotent(spark):
    c = spark.createDataFrame([("d1", "a\n\nb"), ("d2", ""), ("d3", "x" * 500)], "fonte string, texto string")
    made = chunks.explode_chunks(c)
    empty = made.limit(0)
    first = chunks.new_chunks(made, empty)
    assert sorted(r.chunk_key for r in first.collect()) == ["d1::0", "d3::0"]
    assert chunks.new_chunks(made, first).count() == 0 and chunks.existing_keys(made, first).count() == 2
    assert tuple(chunks.vector_report(c, c, made, first).first()) == (3, 3, 2, 2, 1, 2, 0)


def store(spark):
    h = math.sqrt(3) / 2
    return spark.createDataFrame([("Q7::0", [1.0, 0.0, 0.0]), ("Q7::1", [0.5, 0.0, h]), ("Q8::0", [0.0, 0.0, 1.0])], "chunk_key string, embedding array<float>")


def test_top_k(spark):
    got = chunks.top_k(store(spark), [1.0, 0.0, 0.0], 10).collect()
    assert [r.chunk_key for r in got] == ["Q7::0", "Q7::1", "Q8::0"] and [round(r.score, 5) for r in got] == [1.0, 0.0, -1.0]
    assert [r.chunk_key for r in chunks.top_k(store(spark), [1.0, 0.0, 0.0], 5, min_score=1.0).collect()] == ["Q7::0"]
    for k, q in ((0, [1.0, 0.0, 0.0]), (-1, [1.0, 0.0, 0.0]), ("3", [1.0, 0.0, 0.0]), (3, [])):
        assert chunks.top_k(store(spark), q, k).count() == 0
    assert chunks.top_k(store(spark).limit(0), [1.0, 0.0, 0.0], 3).count() == 0


def test_top_k_batch_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (90, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_key int, embedding array<float>")
    q = df.where("chunk_key % 9 = 0").withColumnRenamed("chunk_key", "query_id")
    got = {(r.query_id, r.posicao): r.chunk_key for r in chunks.top_k_batch(df, q, 4, block=7).collect()}
    for i in range(0, 90, 9):
        score = 1 - ((v - v[i]) ** 2).sum(1)
        assert [got[i, p] for p in range(1, 5)] == sorted(range(90), key=lambda j: (-score[j], j))[:4]


def test_embed(spark):
    made = spark.createDataFrame([("a b a",), ("",), (None,)], "texto string")
    got = [np.linalg.norm(r.embedding) for r in chunks.embed(made, chunks.hashing_encoder(8)).collect()]
    assert [round(float(x), 5) for x in got] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="vectors for"):
        chunks.embed(made, lambda: lambda texts: np.ones((1 + len(texts), 2))).collect()


def test_robots(spark):
    texts = spark.createDataFrame([("a.br", "User-agent: *\nDisallow: /acervo/*\nUser-agent: bot\nDisallow: /loja"), ("b.br", "user-agent: *\ndisallow: /"), ("c.br", "User-agent: *\nDisallow:\nDisallow: /x.y(z")], "host string, texto string")
    urls = spark.createDataFrame([(u,) for u in ("https://a.br/acervo/9", "https://a.br/loja", "http://b.br/x", "http://c.br/a", "http://c.br/x.y(z1", "http://c.br/xxy(z", "http://d.br/", None)], "url string")
    assert {r.url for r in robots.filter_robots(urls, robots.parse_rules(texts)).collect()} == {"https://a.br/loja", "http://c.br/a", "http://c.br/xxy(z", "http://d.br/", None}


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><item><title>Barco <b>novo</b></title><link>/n/1</link><pubDate>Tue, 03 May 2022 08:30:00 -0400</pubDate><description>&lt;p&gt;Vela &amp;amp; remo&lt;/p&gt;</description></item>
<item><title>Porto fecha</title><guid>https://gazeta.example/n/2</guid></item><item><title>Sem rumo</title><description>&lt;a href="#"&gt;&lt;/a&gt;&lt;a href="/n/3"&gt;x&lt;/a&gt;</description></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item rdf:about="https://gazeta.example/r"><title>R</title><dc:date>2022-10-12T06:00:00Z</dc:date></item></rdf:RDF>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://gazeta.example/a/"/><published>2023-01-19T00:00:00Z</published><summary>s</summary></entry></feed>"""
LISTING = """<div class="newsItem"><h2><a href="/l/1">Regata</a></h2><span class="date">05/06/2022</span><p>Largada cedo</p></div>
<div class="newsItem"><h3><a href="/l/2">Estaleiro</a></h3><p>21/11/2022</p></div><div class="item"><h2><a href="/l/3">Never</a></h2></div>"""


def contents(spark, pairs):
    return spark.createDataFrame([(p, "IF", "https://gazeta.example", c) for p, c in pairs], "portal string, instituicao string, base string, conteudo string")


def test_feeds_and_listings(spark):
    feeds = contents(spark, [("rss", RSS), ("rdf", RDF), ("atom", ATOM), ("bad", "<rss><item>"), ("none", None)])
    got = {(r.portal, r.ordem): (r.titulo, r.data, r.url, r.texto) for r in items.parse_feeds(feeds).collect()}
    assert got == {
        ("rss", 0): ("Barco novo", "2022-05-03", "https://gazeta.example/n/1", "Vela & remo"), ("rss", 1): ("Porto fecha", None, "https://gazeta.example/n/2", ""), ("rss", 2): ("Sem rumo", None, "https://gazeta.example/n/3", "x"),
        ("rdf", 0): ("R", "2022-10-12", "https://gazeta.example/r", ""), ("atom", 0): ("A", "2023-01-19", "https://gazeta.example/a", "s"),
    }
    listings = contents(spark, [("rss", LISTING), ("bad", LISTING), ("links", '<p><a href="/x">X</a> <em>01/02/2020</em></p><a href="#">no</a>')])
    both = items.extract_items(feeds, listings)
    found = {(r.portal, r.titulo): (r.data, r.url, r.origem) for r in both.where("portal in ('bad', 'links')").collect()}
    assert found == {
        ("bad", "Regata"): ("2022-06-05", "https://gazeta.example/l/1", "listagem"), ("bad", "Estaleiro"): ("2022-11-21", "https://gazeta.example/l/2", "listagem"), ("links", "X"): ("2020-02-01", "https://gazeta.example/x", "listagem"),
    }
    assert both.where("portal = 'rss' and origem = 'listagem'").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('﻿a,b,c\n1,"x ""q"",\ny",3\n4,5\n6,7,8,9\n'.encode())
    good, bad = files.split_rejected(files.read_table_csv(spark, str(tmp_path / "t.csv"), ["a", "b", "c"]))
    assert [tuple(r) for r in good.orderBy("a").collect()] == [("1", 'x "q",\ny', "3"), ("4", "5", None)] and [r.line for r in bad.collect()] == ["6,7,8,9"]
    (tmp_path / "l.json").write_text('[{"titulo": "t", "data": null}, "s", 5]')
    (tmp_path / "o.json").write_text('{"a": 1}')
    found, errors = files.read_items_json(spark, str(tmp_path / "*.json"))
    assert [(r.titulo, r.data, r.pos) for r in files.item_fields(found).collect()] == [("t", None, 0)]
    assert sorted((r.pos, r.kind) for r in errors.where("pos is not null").collect()) == [(1, "STRING"), (2, "BIGINT")] and errors.count() == 3
    (tmp_path / "x.json").write_text('{"a": "98.765.432/0001-10", "b": "00000000000700", "c": "7", "d": 5}')
    assert {r.tax_id for r in files.read_crosswalk(spark, str(tmp_path / "x.json")).collect()} == {"98765432000110", "00000000000700"}
    (tmp_path / "broken.json").write_text("[")
    assert files.read_crosswalk(spark, str(tmp_path / "broken.json")).count() == 0
    with pytest.raises(ValueError):
        files.read_corpus(spark, str(tmp_path / "t.csv"))


def test_sniff_header(spark, tmp_path):
    cases = {"bom": "﻿a;b".encode(), "latin": "ação,b\n1".encode("cp1252"), "plain": b'"a"\t b\n', "none": b"single\n", "tie": b"a,b;c\n", "long": b"a|" * 200_000}
    for name, data in cases.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in files.sniff_header(spark, str(tmp_path / "*.txt")).collect()}
    assert {k: (r.encoding, r.delimiter) for k, r in got.items()} == {
        "bom": ("utf-8-sig", ";"), "latin": ("cp1252", ","), "plain": ("utf-8", "\t"), "none": ("utf-8", ";"), "tie": ("utf-8", ","), "long": ("utf-8", "|"),
    }
    assert got["plain"].columns == ["a", "b"] and got["long"].truncated and not got["bom"].truncated


def test_targets(spark):
    config = spark.createDataFrame([('{"top": "x", "meta": {"a": "no"}, "NORTE": {"PORTO": "http://porto/", "SUB": {"CAIS": "http://cais"}, "INPI": {"b": "no"}}, "SUL": {"FAROL-9": "http://farol//"}}',)], "v string")
    assert {tuple(r) for r in files.flatten_targets(spark, config).collect()} == {("PORTO", "http://porto"), ("CAIS", "http://cais"), ("FAROL-9", "http://farol")}


def test_targets_at_any_depth(spark):
    deep = '{"X": "http://x/"}'
    for k in range(9):
        deep = f'{{"L{k}": {deep}, "T{k}": "http://t{k}"}}'
    config = spark.createDataFrame([(deep,), (None,), ("no json",)], "v string")
    assert {tuple(r) for r in files.flatten_targets(spark, config).collect()} == {("X", "http://x")} | {(f"T{k}", f"http://t{k}") for k in range(8)}
    assert files.flatten_targets(spark, config.limit(0)).collect() == []


def test_small_ones(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert rows.project_tolerant(df, ["y", "x"]).first() == ("", "a")
    assert rows.schema_drift(["a", "z"], ["a", "b"], df).first()[0:4] == (["a"], ["b"], ["z"], False)
    c = spark.createDataFrame([(False, "t"), (True, " "), (True, "ok"), (None, "t")], "na_janela boolean, texto string")
    assert tuple(rows.exclusion_counts(c).first()) == (1, 2, 1) and rows.select_candidates(c).count() == 1
    assert rows.filter_by_name(df, "x", "A").count() == 1


def test_deep_pages_twin_links_and_dates_by_selector(spark):
    deep = "<div>" * 5000 + '<article><h2><a href="/d">Deep</a></h2></article>' + "</div>" * 5000
    page = (
        '<div class="newsItem"><span class="date">02/03/2021</span><time datetime="2020-05-06">x</time><h2><a href="HTTP://P.example/a/">A</a></h2></div>'
        '<div class="newsItem"><h2><a href="https://p.example/a">A</a></h2></div><div class="newsItem"><p>2024-01-02 no</p><p>7/8/2023 10:30</p><h3><a href="/b">B</a></h3></div>'
    )
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><summary>&lt;a href="#"&gt;x&lt;/a&gt;&lt;a href="/s"&gt;y&lt;/a&gt;</summary></entry></feed>'
    got = items.parse_listings(contents(spark, [("deep", deep), ("page", page)])).orderBy("portal", "ordem").collect()
    assert [(r.portal, r.titulo, r.data) for r in got] == [("deep", "Deep", None), ("page", "A", "2020-05-06"), ("page", "B", "2023-08-07")]
    assert [r.url.rsplit("/", 1)[1] for r in items.parse_feeds(contents(spark, [("atom", atom)])).collect()] == ["s"]


def test_ties_and_null_keys_have_one_outcome(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), (None, 1, "n"), (None, 2, "m")], "key string, ordem int, v string")
    for n in (1, 3):
        d = df.repartition(n)
        assert {tuple(r) for r in rows.last_wins(d, ["key"], ["ordem"]).collect()} == {("a", 1, "y"), (None, 2, "m")}
        assert {tuple(r) for r in rows.dedup_first(d, ["key"], ["ordem"]).collect()} == {("a", 1, "x"), (None, 1, "n"), (None, 2, "m")}
        assert {tuple(r) for r in rows.merge_items(d.limit(0), d, "key", "ordem").collect()} == {("a", 1, "x", "novo"), (None, 1, "n", "novo")}
        assert {r.estado for r in rows.merge_items(d, d, "key", "ordem").collect()} == {"existente"}


def test_search_by_text_and_the_vector_job(spark, tmp_path):

    def counting():
        encode = chunks.hashing_encoder(16)()
        return lambda texts: encode(texts)

    corpus = spark.createDataFrame([("p", "water law", True), ("q", "solar panels", True), ("r", "old", False), ("s", " ", True)], "fonte string, texto string, na_janela boolean")
    path = str(tmp_path / "store")
    first = chunks.index_documents(corpus.where("fonte = 'p'"), path, counting).first()
    assert (first.chunks, first.adicionados, first.ja_presentes) == (1, 1, 0)
    again = chunks.index_documents(corpus, path, counting, spark.read.parquet(path)).first()
    assert (again.linhas, again.candidatos, again.chunks, again.adicionados, again.ja_presentes) == (4, 2, 2, 1, 1)
    store = spark.read.parquet(path)
    assert store.count() == 2
    assert [r.chunk_key for r in chunks.search_text(store, "Solar  panels", counting, 1).collect()] == ["q::0"]
    assert [round(r.score, 4) for r in chunks.search_text(store, "water law", counting, 5, min_score=0.9).collect()] == [1.0]
    for bad in ((" ", 3, None), (None, 3, None), ("x", 0, None), ("x", 2.5, None), ("x", 3, "high")):
        assert chunks.search_text(store, bad[0], counting, bad[1], bad[2]).collect() == []
    asked = spark.createDataFrame([(1, "solar panels"), (2, "water law"), (3, " "), (4, None)], "query_id int, texto string")
    assert {(r.query_id, r.chunk_key) for r in chunks.search_texts(store, asked, counting, 1).collect()} == {(1, "q::0"), (2, "p::0")}


def test_ingest_report_counts_and_reasons(spark):
    portals = spark.createDataFrame([("a", True, None), ("b", False, None), ("c", None, "timeout"), ("d", True, None), ("e", True, None)], "portal string, robots_ok boolean, erro string")
    found = spark.createDataFrame([("a", "k1", "feed"), ("a", "k2", "feed"), ("a", "k2", "feed"), ("e", "k2", "listagem"), ("e", "k3", "listagem")], "portal string, key string, origem string")
    got = items.ingest_report(portals, found, spark.createDataFrame([("k1",)], "key string")).orderBy("portal").collect()
    assert [tuple(r) for r in got] == [
        ("a", "feed", 3, 1, 2, None, None), ("b", None, 0, 0, 0, "robots.txt", None), ("c", None, 0, 0, 0, None, "timeout"), ("d", None, 0, 0, 0, "sem itens", None), ("e", "listagem", 2, 1, 1, None, None),
    ]
