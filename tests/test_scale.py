"""Operators whose cost must not grow with lists, files or texts, against plain versions."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from lavra.functions import chunking
from lavra.operators import chunks, parties, robots
from lavra.sources import files

ROOTS = ["INSTITUTO FEDERAL DE", "COLEGIO PEDRO II"]


def plain_pack(paragraphs, most):
    out, size = [], 0
    for p in paragraphs:
        if out and size + len(p) <= most:
            out[-1].append(p)
            size += len(p)
        else:
            out.append([p])
            size = len(p)
    return [" ".join(c) for c in out]


def test_chunks_equal_the_plain_fold_and_cost_no_more_than_the_text(spark):
    rng = random.Random(2)
    rows = [(k, ["x" * rng.randrange(1, 60) for _ in range(rng.randrange(0, 40))]) for k in range(200)] + [(200, []), (201, ["y" * 1000]), (202, ["z" * 20] * 10)]
    df = spark.createDataFrame([*rows, (203, None)], "k int, p array<string>")
    got = {r.k: r.c for r in df.select("k", chunking.pack_chunks(F.col("p"), 20).alias("c")).collect()}
    assert {k: got[k] for k, _ in rows} == {k: plain_pack(p, 80) for k, p in rows} and not got[203]

    def took(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.repeat(F.lit("w"), F.lit(30))).alias("p"))
        began = time.time()
        assert df.select(F.size(chunking.pack_chunks(F.col("p"), 10)).alias("n")).first().n == n
        return time.time() - began

    took(1000)
    short, long = took(100_000), took(400_000)
    assert long < 8 * short + 2


def test_headers_of_files_that_no_memory_holds(spark, tmp_path):
    with open(tmp_path / "big.csv", "wb") as f:
        f.write(b"a;b\n")
        f.truncate(6 << 30)
    with open(tmp_path / "endless.csv", "wb") as f:
        f.truncate(3 << 30)
    began = time.time()
    got = {r.path.rsplit("/", 1)[1]: (r.columns, r.truncated) for r in files.sniff_header(spark, str(tmp_path / "*.csv")).collect()}
    assert got["big.csv"] == (["a", "b"], False) and got["endless.csv"][1]
    assert time.time() - began < 30


def fits(rule, path):
    return rule == "/" or re.match(".*".join(map(re.escape, rule.split("*"))), path) is not None


def test_rules_by_their_beginning_equal_trying_each(spark):
    rng = random.Random(4)
    part = lambda: rng.choice(["/", "/a", "/ab", "*", ".html", "/x.y(z", "b/", "/a*b", "$", "\\Q", "/é"])
    rules = {f"h{k}.br": ["".join(part() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 12))] for k in range(12)}
    rules["h0.br"] = ["/"]
    texts = spark.createDataFrame([(h, "user-agent: *\n" + "\n".join(f"disallow: {r}" for r in rs)) for h, rs in rules.items()], "host string, texto string")
    urls = [(k, f"https://{rng.choice(list(rules) + ['free.br'])}" + "".join(part() for _ in range(rng.randrange(0, 5))).replace("*", "q")) for k in range(1500)]
    urls = [(k, u if u.count("/") > 2 or u.endswith(".br") else u.replace(".br", ".br/", 1)) for k, u in urls]
    split = lambda u: re.match(r"https://([^/?#]*)([^?#;]*)", u).groups()
    want = sorted((k, u) for k, u in urls if not any(fits(r.lower(), split(u)[1]) for r in rules.get(split(u)[0].lower(), []) if r.strip()))
    frame = spark.createDataFrame([(k, u, "mine", "mine too") for k, u in urls], "k int, url string, _host string, path string")
    kept = robots.filter_robots(frame, robots.parse_rules(texts))
    assert kept.columns == frame.columns and {(r._host, r.path) for r in kept.collect()} == {("mine", "mine too")}
    assert sorted((r.k, r.url) for r in kept.collect()) == want


def test_a_host_of_very_many_rules_and_urls(spark):
    rules = "user-agent: *\n" + "\n".join(f"disallow: /d{k}/" for k in range(10_000)) + "\ndisallow: /*.pdf"
    texts = spark.createDataFrame([("big.br", rules)], "host string, texto string")
    urls = spark.range(30_000).select(F.concat(F.lit("http://big.br/d"), F.col("id"), F.when(F.col("id") % 100 == 99, "/a.pdf").otherwise("/a")).alias("url"))
    kept = robots.filter_robots(urls, robots.parse_rules(texts))
    assert kept.count() == 20_000 - 200


def test_many_roots_equal_few(spark):
    rng = random.Random(6)
    roots = ["AB", "B", "ABC", "CA", "ABA", "BB C", "C"]
    names = ["".join(rng.choice("ABC ") for _ in range(rng.randrange(0, 9))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = [r.r for r in df.select(parties.root_of(F.col("n"), roots).alias("r")).collect()]
    more = [*roots, *(f"Z{k}" for k in range(10_000)), "AB"]
    assert [r.r for r in df.select(parties.root_of(F.col("n"), more).alias("r")).collect()] == want
    some = ["ABC", "", *more]
    assert [r.r for r in df.select(parties.root_of(F.col("n"), some).alias("r")).collect()] == [None if n is None else "ABC" if "ABC" in n else "" for n in names]


def registry(spark, numbers=("BR1", " BR1", "BR1 \t", "BR2")):
    rows = [(n, "INSTITUTO FEDERAL DE X", "12.345.678/0001-90", k) for k, n in enumerate(numbers)]
    depositors = spark.createDataFrame(rows, "numero_inpi string, depositante string, cgccpfdepositante string, ordem int")
    content = spark.createDataFrame([("BR1  ", "nan", "abstract", 0), (" BR1", "title", "later", 1)], "numero_inpi string, titulo string, resumo string, ordem int")
    biblio = spark.createDataFrame([("\tBR1", "2020-01-01", 0)], "numero_inpi string, data_deposito string, ordem int")
    return depositors, content, biblio, spark.createDataFrame([("12345678000190",)], "tax_id string")


def test_padded_numbers_are_one_filing(spark):
    depositors, content, biblio, ids = registry(spark)
    got = parties.extract_registry(depositors, content, biblio, ids.limit(0), ROOTS).collect()
    assert [tuple(r) for r in got] == [("BR1", ["INSTITUTO FEDERAL DE X"], 0, "title", "abstract", "2020-01-01"), ("BR2", ["INSTITUTO FEDERAL DE X"], 3, "", "", "")]
    classified = parties.classify_party(depositors, "depositante", "cgccpfdepositante", ids, ROOTS)
    assert parties.match_counts(classified, "numero_inpi").first().depositos == 2
    assert parties.restrict_to_network(content, depositors, "numero_inpi").count() == 2


def test_absent_columns_are_blank(spark):
    depositors, content, biblio, ids = registry(spark)
    job = lambda d, c, b, x: [tuple(r) for r in parties.extract_registry(d, c, b, x, ROOTS).drop("ordem").collect()]
    label = ["12345678000190"]
    assert job(depositors.drop("depositante"), content, biblio, ids) == [("BR1", label, "title", "abstract", "2020-01-01"), ("BR2", label, "", "", "")]
    assert job(depositors.drop("depositante"), content, biblio, ids.limit(0)) == []
    assert [r[1] for r in job(depositors.drop("cgccpfdepositante"), content, biblio, ids)] == [["INSTITUTO FEDERAL DE X"]] * 2
    assert [r[2:4] for r in job(depositors, content.drop("titulo"), biblio, ids)] == [("", "abstract"), ("", "")]
    assert [r[4] for r in job(depositors, content, biblio.drop("data_deposito"), ids)] == ["", ""]
    assert [r[2] for r in job(depositors, content.drop("numero_inpi"), biblio, ids)] == ["", ""]
    assert job(depositors.drop("numero_inpi"), content, biblio, ids) == []


def test_users_columns_stay(spark):
    depositors, _, _, ids = registry(spark)
    mine = depositors.selectExpr("*", "1 as _digits", "2 as held", "3 as folded", "4 as Listed")
    assert parties.classify_party(mine, "depositante", "cgccpfdepositante", ids, ROOTS).columns == [*mine.columns, "raiz", "rotulo"]


def test_report_of_the_registry_job(spark):
    depositors, content, biblio, ids = registry(spark)
    filings = parties.extract_registry(depositors, content, biblio, ids.limit(0), ROOTS)
    gate = spark.createDataFrame([(True,)], "usable boolean")
    report = lambda **more: parties.registry_report(depositors, filings, content, ids.limit(0), ROOTS, **{"gate": gate} | more).first()
    good = report()
    assert (good.veredito, good.n_registros_csv, good.n_casados_rede, good.n_descartados, good.linhas_rejeitadas) == ("ok", 2, 4, 0, 2)
    assert good.cobertura_por_raiz == {ROOTS[0]: 4, ROOTS[1]: 0, "crosswalk_cnpj": 0} and not good.crosswalk_presente and good.erro is None
    assert report(gate=gate.limit(0)).veredito == "pendente" and report(gate=spark.createDataFrame([(False,)], "usable boolean")).veredito == "pendente"
    failed = report(errors=("no table", "no disk"), missing=("conteudo",))
    assert (failed.veredito, failed.erro, failed.membros_ausentes) == ("pendente", "no table; no disk", ["conteudo"])


def plain_top(vectors, queries, k):
    out = {}
    for i, q in queries:
        score = [(-round(1 - sum((a - b) ** 2 for a, b in zip(q, v)), 9), j) for j, v in vectors]
        out |= {(i, p): j for p, (_, j) in enumerate(sorted(score)[:k], 1)}
    return out


def test_search_skips_far_blocks_and_equals_brute_force(spark):
    rng = random.Random(8)
    centres = [[rng.uniform(-20, 20) for _ in range(4)] for _ in range(12)]
    near = lambda c: [x + rng.choice([-0.5, 0.0, 0.25, 0.5]) for x in map(round, c)]
    vectors = [(j, [float(x) for x in near(rng.choice(centres))]) for j in range(1500)]
    vectors += [(j, vectors[0][1]) for j in range(1500, 2000)]  # a very common vector
    queries = [(j, v) for j, v in vectors if j % 50 == 0] + [(9000, [0.0] * 4), (9001, vectors[0][1])]
    store = spark.createDataFrame(vectors, "chunk_key int, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([*queries, (9002, None), (9003, [])], "query_id int, embedding array<float>")
    found = chunks.top_k_batch(store, asked, 7, block=40)
    assert {(r.query_id, r.posicao): r.chunk_key for r in found.collect()} == plain_top(vectors, queries, 7)
    pairs, qs, vs = chunks.block_pairs(store, asked, 7, None, "chunk_key", "embedding", "query_id", 40)
    share = pairs.count() / (qs.count() * vs.count())
    assert share < 0.4, share
    above = chunks.top_k_batch(store, asked, 7, min_score=0.2, block=40).collect()
    assert sorted(map(tuple, above)) == sorted(tuple(r) for r in found.collect() if r.score >= 0.2)


def test_search_without_clusters_and_with_few_rows_is_a_full_scan(spark):
    rng = random.Random(9)
    vectors = [(j, [rng.gauss(0, 1) for _ in range(24)]) for j in range(300)]
    store = spark.createDataFrame(vectors, "chunk_key int, embedding array<double>")
    asked = store.where("chunk_key % 50 = 0").withColumnRenamed("chunk_key", "query_id")
    queries = [(j, v) for j, v in vectors if j % 50 == 0]
    for k, block in ((5, 30), (400, 64), (3, 4096)):
        got = {(r.query_id, r.posicao): r.chunk_key for r in chunks.top_k_batch(store.withColumn("embedding", F.col("embedding").cast("array<float>")), asked, k, block=block).collect()}
        want = plain_top([(j, [float(np.float32(x)) for x in v]) for j, v in vectors], [(j, [float(np.float32(x)) for x in v]) for j, v in queries], k)
        assert got == want
    assert chunks.top_k_batch(store.limit(0), asked, 3).collect() == [] and chunks.top_k_batch(store, asked.limit(0), 3).collect() == []


def test_chunks_are_made_once_for_each_text(spark, capsys):
    docs = spark.range(3).select(F.concat(F.lit("d"), F.col("id")).alias("fonte"), F.array_join(F.array_repeat(F.lit("line of words"), F.col("id").cast("int")), "\n\n").alias("texto"))
    made = chunks.explode_chunks(docs, tokens=4)
    assert [(r.chunk_key, r.n_chunks, r.texto) for r in made.orderBy("chunk_key").collect()] == [("d1::0", 1, "line of words"), ("d2::0", 2, "line of words"), ("d2::1", 2, "line of words")]
    made.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_scores_of_few_queries_are_held_at_once():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    q, v = rng.standard_normal((1000, 4)), rng.standard_normal((70, 4))
    qi, vi = pa.array([list(range(1000))])[0], pa.array([list(range(70))])[0]
    parts = list(chunks._scores(qi, pa.array([q.ravel().tolist()])[0], vi, pa.array([v.ravel().tolist()])[0]))
    assert all(s.shape[0] <= chunks.SLICE and s.shape[1] == 70 for _, s in parts)
    want = 1 - ((q[:, None, :] - v[None, :, :]) ** 2).sum(2)
    assert np.allclose(np.concatenate([s for _, s in parts]), want) and [at for at, _ in parts] == list(range(0, 1000, chunks.SLICE))


def of_lines(spark, n=9):
    """Document k of k lines, of three chunks where k is 3."""
    return spark.range(n).select(F.concat(F.lit("d"), F.col("id")).alias("fonte"), F.array_join(F.array_repeat(F.lit("line of words"), F.col("id").cast("int")), "\n\n").alias("texto"))


def test_stored_ids_are_found_with_each_text_cut_once_for_each_side(spark, capsys):
    made = chunks.explode_chunks(of_lines(spark), tokens=4)
    found = chunks.existing_keys(made, chunks.explode_chunks(of_lines(spark).where("fonte in ('d0', 'd3', 'd6')"), tokens=4))
    found.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 2
    assert sorted(r.chunk_key for r in found.collect()) == [f"d{k}::{i}" for k in (3, 6) for i in range(k)]


def test_vectors_are_made_with_each_text_cut_once_and_words_counted_as_one_by_one(spark, capsys):
    import zlib

    vectors = chunks.embed(chunks.explode_chunks(of_lines(spark), tokens=4), chunks.hashing_encoder(8))
    vectors.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 2  # the chunks' ends, the encoder
    assert vectors.count() == sum(range(9)) and {len(r.embedding) for r in vectors.collect()} == {8}

    texts = ["", " \n ", "a", "A a b É ÿ", "İ ς 日本 ß " * 50, "x" * 100_000]
    want = np.zeros((len(texts), 8))
    for row, text in zip(want, texts):
        for word in text.lower().split():
            row[zlib.crc32(word.encode()) % 8] += 1
    got = chunks.hashing_encoder(8)()(texts)
    assert got.dtype == np.float64 and (got == want).all() and chunks.hashing_encoder(8)()([]).shape == (0, 8)


def test_a_filter_on_the_number_of_chunks_makes_no_chunks_anew(spark, capsys):
    made = chunks.explode_chunks(of_lines(spark), tokens=4).where("n_chunks > 6")
    made.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert sorted((r.chunk_key, r.chunk_idx, r.n_chunks, r.texto) for r in made.collect()) == [(f"d{k}::{i}", i, k, "line of words") for k in (7, 8) for i in range(k)]


def test_chunk_ends_of_a_batch_come_from_one_prefix_sum(monkeypatch):
    import pyarrow as pa

    from lavra.functions import chunking

    def plain(sizes, most):
        ends, total = [], 0
        for i, n in enumerate(sizes):
            if i and total + n > most:
                ends.append(i)
                total = 0
            total += n
        return [*ends, len(sizes)] if sizes else []

    rng = np.random.default_rng(7)
    rows = [None, [], [1], [500, 1, 500, 239, 1, 1], [120, 120, 1], *(rng.integers(1, 300, n).tolist() for n in (1, 2, 50, 3000)), None, [2**31 - 1] * 3, [1] * 5000]
    sums, cumsum = [], np.cumsum
    monkeypatch.setattr(chunking.np, "cumsum", lambda *a, **k: sums.append(1) or cumsum(*a, **k))
    batch = pa.array(rows, pa.list_(pa.int32()))
    for most in (1, 240, 2**31):
        ends = chunking._ends(most).func
        assert ends(batch).to_pylist() == [plain(r or [], most) for r in rows]
        assert ends(batch.slice(3, 5)).to_pylist() == [plain(r or [], most) for r in rows[3:8]]
    assert ends(batch.slice(0, 0)).to_pylist() == [] and ends(batch.slice(0, 2)).to_pylist() == [[], []]
    assert len(sums) == 8  # one for each batch, however many texts are in it
