import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lavra.functions import chunking, dates, text, urls, vectors


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("mode", ["regex", "parser"])
def test_clean_html(spark, mode):
    got = values(spark, lambda c: text.clean_html(c, mode), ["<li>chuva&nbsp;forte</li>", "no <em>rio &amp; no lago</em>", None, " \t", "dois\n versos"])
    assert got == ["chuva forte", "no rio & no lago", "", "", "dois versos"]


def test_clean_html_modes_differ(spark):
    page = ["<p>a</p><script>var x</script>&amp;lt;"]
    assert values(spark, text.clean_html, page) == ["a var x &lt;"]
    assert values(spark, lambda c: text.clean_html(c, "parser"), page) == ["a <"]


def test_white_space_and_folding(spark):
    assert values(spark, text.collapse_ws, ["a\xa0\x1c b\n", None]) == ["a b", ""]
    assert values(spark, text.fold_upper, ["Estação  Júlio IV", "straße", None, "ﬁ"]) == ["ESTACAO  JULIO IV", "STRASSE", "", "FI"]


def test_labels(spark):
    joined = ["MUSEU DO MAR |ESCOLA DE VELA| FAROL SUL", "", None, "|cais|"]
    assert values(spark, text.main_label, joined) == ["MUSEU DO MAR", "", "", "cais"]
    assert values(spark, text.other_labels, joined) == ["ESCOLA DE VELA|FAROL SUL", "", "", ""]


def test_lenient_dates(spark):
    got = values(spark, dates.normalize_iso, ["2021-11-03", "17/02/2022", "2021-11-03T08:15:00Z", "", "sem data", "2021-14-33", "0000-07-09", "3/4/2021x", None])
    assert got == ["2021-11-03", "2022-02-17", "2021-11-03", "", "", "", "", "2021-04-03", ""]


def test_strict_dates(spark):
    strict = lambda c: dates.parse_iso_strict(c).cast("string")
    got = values(spark, strict, ["2020-09-14abc", "2020-09-14T05:00:00", "2021-03-04 11:45", " 2021-03-04 ", "2022-02-30", None, "1050-10-10"])
    assert got == [None, "2020-09-14", "2021-03-04", "2021-03-04", None, None, "1050-10-10"]
    assert values(spark, lambda c: dates.is_plausible(c.cast("date")), ["1799-01-01", "1800-01-01", "2101-01-01"]) == [False, True, False]


def test_feed_dates(spark):
    cases = {
        "17/02/2022 07h45": "2022-02-17", "Tue, 03 May 2022 08:30:00 -0400": "2022-05-03", "sem data": None, "2022-05-03T21:10:09.5-04:00": "2022-05-03",
        "03/05/2022 08:30": "2022-05-03", "2021-15-37": "2021-15-37", "Wed, 30 Feb 2022 08:30:00 GMT": None, "2022-05-03": "2022-05-03", "33/05/2022": None, "": None,
    }
    assert values(spark, dates.parse_pubdate, list(cases)) == list(cases.values())


def test_urls(spark):
    cases = {
        "https://Museu.example/": "https://museu.example", "HTTP://museu.example/Mapa/": "https://museu.example/Mapa", "": "", "http://a.b/p;x?q=1/#F": "https://a.b/p?q=1/#F",
        "ftp://U@H:21/A//": "ftp://u@h:21/A", "//h/x": "https://h/x",
    }
    assert values(spark, urls.normalize_url, list(cases)) == list(cases.values())
    assert values(spark, lambda c: urls.resolve_url(F.lit("http://a.b/c/d"), c), ["e/", "/f", "http://g", "", None]) == ["https://a.b/c/e", "https://a.b/f", "https://g", "", ""]
    key = lambda c: urls.item_key(c, F.lit(" Title "), F.lit("INST"), F.lit(None).cast("string"))
    assert values(spark, key, ["http://x/", "", None]) == ["url:https://x", "semurl:title|inst|", "semurl:title|inst|"]


def test_paragraphs_and_chunks(spark):
    assert values(spark, chunking.split_paragraphs, ["Cedo.\n\nTarde.\n\n\n  \nNoite.", "", None]) == [["Cedo.", "Tarde.", "Noite."], [], []]
    five = "\n\n".join(["k" * 400] * 5)
    pack = lambda c: chunking.pack_chunks(chunking.split_paragraphs(c), 50)
    got = values(spark, pack, [five, "a\n\nb\n\n" + "c" * 198 + "\n\nd", "  ", None])
    assert got == [["k" * 400] * 5, ["a b " + "c" * 198, "d"], [], []]
    assert chunking.target_chars(0) == chunking.target_chars(None) == 1600 and chunking.target_chars(-3) == 1
    assert values(spark, lambda c: chunking.chunk_key(c, F.lit(2)), ["Q7", " ", None]) == ["Q7::2", "(sem fonte)::2", "(sem fonte)::2"]


def test_repair_encoding(spark):
    good = "Às três a maré já baixou"
    df = spark.createDataFrame([(bytearray(good.encode("cp1252")),), (bytearray(good.encode()),), (None,), (bytearray(b"\x81\xff"),)], "b binary")
    got = [r.t for r in df.select(text.repair_encoding(F.col("b")).alias("t")).collect()]
    assert got == [good, good, None, b"\x81\xff".decode("utf-8", "replace")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.l2_normalize(F.col("a")).alias("u"), vectors.l2_score(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(list(map(lambda x: round(x, 6), r.u)), r.s) for r in got] == [([0.6, 0.8], 1.0), ([0.0, 0.0], 0.0)]


def test_links_resolve_as_the_standard_library_does(spark):
    bases = ["http://a.b/c/d;p?q", "https://A.b", "http://a.b/c//d/./e/", "HTTP://a/b?x=/y", "/only/path", "", "mailto:x@y", "ftp://h/x/y"]
    hrefs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "g;x=1/../y", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http:g", "HTTPS://Z/../q", "mailto:a@b", " g\t"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", urls.absolute_url(F.col("b"), F.col("h")).alias("r")).collect()
    wrong = [(r.b, r.h, r.r, urljoin(r.b, r.h.strip()) if r.h.strip() else "") for r in got if r.r != (urljoin(r.b, r.h.strip()) if r.h.strip() else "")]
    assert not wrong, wrong


def test_repaired_encodings_are_those_of_the_standard_library(spark):
    def plain(raw):
        for name in ("utf-8", "cp1252"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        return raw.decode("utf-8", "replace")

    rng = random.Random(4)
    pieces = [bytes([b]) for b in range(128, 256)] + ["é".encode(), "€".encode(), "😀".encode(), b"abc ", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf5\x80", b"\x00", b"\n"]
    data = [b"", *pieces, *(b"".join(rng.choices(pieces, k=rng.randrange(1, 7))) for _ in range(1500)), *(b"\x81" + b"".join(rng.choices(pieces[128:], k=4)) for _ in range(300))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate([*data, None])], "i int, x binary").select("i", text.repair_encoding(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [*map(plain, data), None]


def test_few_results_of_a_batch_are_objects_at_once():
    import pyarrow as pa

    from lavra.functions.binding import in_slices

    class Result(dict):
        live = most = 0

        def __init__(self, n):
            super().__init__(n=n)
            Result.live += 1
            Result.most = max(Result.most, Result.live)

        def __del__(self):
            Result.live -= 1

    kind = pa.struct([("n", pa.int64())])
    got = in_slices(pa.array([None, *range(999)]), Result, kind)
    assert got.to_pylist() == [None, *({"n": n} for n in range(999))] and Result.most <= 128
    assert in_slices(pa.array([], pa.int64()), Result, kind).to_pylist() == []


def test_references_without_semicolon_are_decoded_as_html_unescape_does(spark):
    assert values(spark, text.clean_html, ["a&amp<p>b &lt;c&ampd"]) == ["a& b <c&d"]
