import math
import random

import pytest
from pyspark.sql import functions as F

from lavra.llm import quality
from lavra.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def halves(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    return docs, labels, train


def test_held_out_accuracy(spark, halves):
    docs, labels, model = halves
    scored = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality").collect()
    right = sum(r.keep == bool(r.quality) for r in scored) / len(scored)
    good = [r.keep for r in scored if r.quality == 1]
    assert right > 0.97 and sum(good) / len(good) > 0.98


def test_posteriors_match_a_plain_computation(spark):
    rng = random.Random(3)
    rows = [(i, f"word{i} other text {'!! ' * rng.randint(0, 6)}", rng.choice(["a", "b", None]), rng.choice(["x", None, "y"]), "c") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability string").withColumn("host", F.lit(0))
    weights = tuple(0.0 if f != "bang_share" else -9.0 for f in quality.FEATURES)
    model = quality.Model(weights, 1.0)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    p = {i: 1 / (1 + math.exp(-(1.0 - 9 * 2 * t.count("!!") / len(t)))) for i, t, *_ in rows}
    mean = sum(p.values()) / len(p)
    _, mean2, hs, ps = quality.posteriors(quality.site_sums(df, model, "source", "lang"))
    assert abs(mean - mean2) < 1e-9
    for i, _, h, q, _ in rows:
        host = [p[j] for j, _, h2, _, _ in rows if h2 == h and j != i]
        path = [p[j] for j, _, h2, q2, _ in rows if (h2, q2) == (h, q) and j != i]
        up = (sum(host) + hs * mean) / (len(host) + hs)
        prior = (sum(path) + ps * up) / (len(path) + ps)
        odds = math.log(p[i] / (1 - p[i])) + math.log(prior / (1 - prior)) - math.log(mean / (1 - mean))
        assert abs(got[i].site_prior - prior) < 1e-6
        assert abs(got[i].probability - 1 / (1 + math.exp(-odds))) < 1e-6


def test_odd_texts_and_empty_tables(spark, halves):
    model = halves[2]
    rows = [(1, None, None, None), (1, "", "s", None), (None, "x" * 100_000, "s", "en"), (2, "word " * 50_000, "s", "en"), (2, "word " * 50_000, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = quality.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert quality.score(df.limit(0), model).collect() == []
    none = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.keep for r in quality.score(df, none).collect())


def plain_strength(groups, noise):
    """Moments of (n, mean) pairs in groups around each group's mean; groups: lists of such pairs, noise: mean -> variance."""
    spread = expected = size = weighted = total = 0.0
    for pairs in groups:
        n = sum(k for k, _ in pairs)
        mid = sum(k * m for k, m in pairs) / n
        spread += sum(k * (m - mid) ** 2 for k, m in pairs)
        expected += (len(pairs) - 1) * noise(mid)
        size += n - sum(k * k for k, _ in pairs) / n
        weighted += n * noise(mid)
        total += n
    between = (spread - expected) / size
    return min(max(weighted / total / between - 1, 2.0), 1000.0) if between > 0 else 1000.0


@pytest.mark.parametrize("host_spread", [0.0, 0.25])
def test_strengths_by_moments_around_the_level_above(spark, host_spread):
    rng = random.Random(11)
    sums = []
    for h in range(30):
        host = 0.5 + rng.choice([-1, 1]) * host_spread
        for p in range(rng.randint(1, 8)):
            n, at = rng.randint(5, 200), min(max(host + rng.uniform(-0.2, 0.2), 0.02), 0.98)
            sums.append((f"h{h}", f"p{p}", n, n * at))
    df = spark.createDataFrame(sums, "host string, path string, n long, mass double")
    _, mean, hs, ps = quality.posteriors(df)
    noise = lambda m: m * (1 - m)
    by_host = {}
    for h, _, n, mass in sums:
        by_host.setdefault(h, []).append((n, mass / n))
    hosts = [(sum(n for n, _ in v), sum(n * m for n, m in v) / sum(n for n, _ in v)) for v in by_host.values()]
    assert abs(mean - sum(m for *_, m in sums) / sum(n for _, _, n, _ in sums)) < 1e-9
    assert abs(ps - plain_strength(by_host.values(), noise)) < 1e-6 * ps
    assert abs(hs - plain_strength([hosts], noise)) < 1e-6 * hs


def test_word_buckets_and_their_weights(spark):
    df = spark.createDataFrame([("Ab cd  ab",), ("ab cd ab",), ("",), (None,), ("x",)], "text string")
    got = [r.b for r in df.select(quality.word_buckets(F.col("text"), 64).alias("b")).collect()]
    assert got[0] == got[1] and len(got[0]) == 5 and got[0][0] == got[0][2] and got[2] == got[3] == [] and len(got[4]) == 1
    by = tuple(float(i) for i in range(64))
    model = quality.Model((0.0,) * len(quality.FEATURES), 0.5, by)
    e = [r.e for r in df.select(model.evidence(F.col("text")).alias("e")).collect()]
    assert all(abs(x - (0.5 + (sum(b) / len(b) if b else 0))) < 1e-9 for x, b in zip(e, got))


def test_clashing_columns_keep_their_values(spark, halves):
    df = spark.createDataFrame([(1, "some text", "s", "en")], "doc_id long, text string, source string, lang string").withColumns({c: F.lit(7) for c in ("e", "s", "prior", "E_", "host", "n")})
    row = quality.score(df, halves[2]).collect()[0]
    assert all(row[c] == 7 for c in ("e", "s", "prior", "E_", "host", "n")) and row.text == "some text"
