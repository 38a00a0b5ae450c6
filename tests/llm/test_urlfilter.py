import random
import re

from pyspark.sql import functions as F

from lavra.llm import urlfilter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


def rule_of(host, path):
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def brute(pages, rounds=300, threshold=0.06):
    parts = [(k, *split(u), h or "") for k, u, h in pages]
    hosts = sorted({p[1] for p in parts})
    edges, seen = {}, {}
    for _, host, path, html in parts:
        for href in re.findall(r"""href\s*=\s*["']?((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^"'\s>]+)""", html):
            target = split("http:" + href if href.startswith("//") else href)[0]
            if host and target and host != target:
                edges[host, target] = edges.get((host, target), 0) + 1
        if r := rule_of(host, path):
            seen.setdefault(host, []).append(r[2] == "block")

    def rank(seeds, links):
        out, total = {}, sum(seeds.values())
        for (s, _), w in links.items():
            out[s] = out.get(s, 0) + w
        r = dict(seeds)
        for _ in range(rounds if seeds else 0):
            ends = sum(x for h, x in r.items() if h not in out)
            new = {s: w * (0.15 + 0.85 * ends / total) for s, w in seeds.items()}
            for (s, t), w in links.items():
                if s in r:
                    new[t] = new.get(t, 0) + 0.85 * r[s] * w / out[s]
            r = new
        return r

    bad = {h: sum(v) / len(v) for h, v in seen.items()}
    trust = rank({h: 1 - b for h, b in bad.items() if b < 1}, edges)
    distrust = rank({h: b for h, b in bad.items() if b > 0}, {(t, s): w for (s, t), w in edges.items()})
    out = []
    for k, host, path, _ in parts:
        t, d = trust.get(host, 0), distrust.get(host, 0)
        r = rule_of(host, path)
        out.append((k, host, path, r and r[3], r[2] if r else "block" if round(d, 3) >= threshold and round(d, 3) > round(t, 3) else "allow"))
    return sorted(out, key=str)


def some_pages():
    rng = random.Random(2)
    hosts = ["a.example.com", "www.example.com", "x.com", "bad.net", "worse.net", "pals.org", "other.org", "shop.de", "far.de"]
    pages = []
    for k in range(120):
        host = rng.choice(hosts)
        lead = {"pals.org": ["bad.net", "worse.net"], "far.de": ["pals.org"], "x.com": ["other.org"]}.get(host, hosts)
        html = "".join(f"<a HREF = '//{rng.choice(lead).upper()}/p'>" if k % 2 else f'<a href="https://{rng.choice(lead)}?q">' for _ in range(3)).replace("HREF", "href")
        pages.append((k, f"HTTP{'s' if k % 3 else ''}://{host.title() if k % 5 == 0 else host}/{rng.choice(['en', 'es', 'fr'])}/{k}?a=/en/#x", html))
    return pages + [(500, None, None), (501, "no scheme", ""), (502, "http://", "x"), (None, "http://a.b?c", None), (503, "http://ÄÖ.net/fr/", ""), (503, "http://ÄÖ.net/fr/", ""), (504, "x://com/y://z", "")]


def test_matches_brute_force(spark):
    pages = some_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rules": F.lit(2), "kind": F.lit(3)}).repartition(3)
    got = sorted(map(tuple, urlfilter.judge(df, urlfilter.rule_table(spark, RULES)).collect()), key=str)
    assert got == brute(pages)
    assert urlfilter.judge(df.limit(0), urlfilter.rule_table(spark, RULES)).collect() == []


def test_one_host_with_all_links_and_no_seeds(spark):
    pages = [(k, "http://hub.org/", f'<a href="http://h{k}.org">') for k in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = urlfilter.judge(df, urlfilter.rule_table(spark, [])).collect()
    assert len(got) == 50 and {r.verdict for r in got} == {"allow"}


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda h: f'<a href="http://{h}/">'
    pages = [(1, "http://bad.net/es/", link("victim.org")), (2, "http://pal.org/", link("bad.net")), (3, "http://x.com/", link("friend.org")), (4, "http://friend.org/", link("bad.net") + link("x.com") * 9), (5, "http://victim.org/", None)]
    pages += [(k, f"http://quiet{k}.org/", "") for k in range(6, 30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r.verdict for r in urlfilter.judge(df, urlfilter.rule_table(spark, RULES)).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad.net", "pal.org"}


def test_isolated_blocked_hosts_are_blocked_however_many_they_are(spark):
    bad = [(k, f"http://b{k}.net/es/{x}", None) for k in range(30) for x in range(2)]
    pages = bad + [(100 + k, f"http://b{k}.net/other", None) for k in range(30)] + [(200, "http://mixed.net/es/", None), (201, "http://mixed.net/fr/", None), (202, "http://new.org/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, urlfilter.rule_table(spark, RULES)).collect()}
    assert all(got[100 + k] == "block" for k in range(30)) and got[202] == "allow"


def test_hubs_are_dealt_out_with_the_same_result(spark, monkeypatch):
    pages = some_pages()
    monkeypatch.setattr(urlfilter, "HUB_LINKS", 2)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(map(tuple, urlfilter.judge(df, urlfilter.rule_table(spark, RULES)).collect()), key=str) == brute(pages)


def test_ranks_equal_the_plain_fixed_point(spark):
    # a -> b, a -> c; c -> a; b has no links: what it gets returns to the seed a.
    edges = spark.createDataFrame([("trust", "a", "b", 0.5), ("trust", "a", "c", 0.5), ("trust", "c", "a", 1.0)], "kind string, source string, target string, share double")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, weight double")
    got = {r.host: r.rank for r in urlfilter.propagate(edges, seeds, tolerance=1e-9).collect()}
    r = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(400):
        r = {"a": 0.15 + 0.85 * (r["c"] + r["b"]), "b": 0.425 * r["a"], "c": 0.425 * r["a"]}
    assert all(abs(got[h] - x) < 1e-6 for h, x in r.items())


def test_the_sql_twin_agrees_where_rank_moves(spark):
    import duckdb
    import pandas as pd

    from lavra.llm import catalog

    pages = some_pages()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    rows = con.sql(catalog.ORACLE_SQL["op10_url_filter"]).fetchall()
    assert sorted(rows, key=str) == brute(pages)
