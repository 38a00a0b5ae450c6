import random

import pytest
from pyspark.sql import functions as F

from lavra.llm import jaccard


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, least=0.8):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and similar(sets[i], sets[j]) >= least] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in near[i])])
            if low < label[i]:
                label[i], changed = low, True
    ids = lambda js: min((rows[j][0] for j in js if rows[j][0] is not None), default=None)
    out = []
    for i, (k, _) in enumerate(rows):
        out.append((k, ids([j for j in range(n) if label[j] == label[i]]), ids([j for j in range(n) if sets[j] == sets[i]]), len(near[i])))
    return sorted(out, key=str)


def corpus(seed=1, near=20):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((k, " ".join(words)))
            k += 1
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(near):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
        k += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [(k + i, " ".join(rng.choice(vocabulary) for _ in range(90)) + " " + passage) for i in range(15)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (None, "one two"), (905, "lonely " + "x" * 50_000), (905, "lonely " + "x" * 50_000)]


def links(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "class": F.lit("q"), "group": F.lit(2)}).repartition(3)
    return sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in jaccard.link_documents(df, **how).collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert links(spark, rows) == brute(rows)


def test_blocks_of_a_large_group_match_brute_force(spark, monkeypatch):
    rows = corpus(2, near=60)
    real = jaccard.block_pairs
    monkeypatch.setattr(jaccard, "block_pairs", lambda m, s: real(m, s, block=7))
    assert links(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [7, 256])
def test_buckets_of_taken_apart_groups_match_brute_force(spark, monkeypatch, block):
    rows = corpus(4, near=40)
    real = jaccard.block_pairs
    monkeypatch.setattr(jaccard, "block_pairs", lambda m, s: real(m, s, block=block))
    assert links(spark, rows, whole_group=1) == brute(rows)


def test_links_are_the_same_by_groups_and_by_buckets(spark):
    # At this recall many pairs of similar texts never meet in a band: chains of others must not link them.
    rows = corpus(5, near=80)
    by_groups, by_buckets = links(spark, rows, recall=0.6, whole_group=10_000), links(spark, rows, recall=0.6, whole_group=1)
    assert by_groups == by_buckets != brute(rows)
    assert all(a[3] <= b[3] for a, b in zip(by_groups, brute(rows)))


def test_band_plan_keeps_its_promises():
    for similarity, recall in ((0.8, 0.999), (0.7, 0.95), (0.9, 0.9999)):
        bands, rows = jaccard.band_plan(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall
        assert 1 - (1 - jaccard.PASSAGE**rows) ** bands <= jaccard.CHANCE
        fewer = jaccard.bands_for(similarity, recall, rows - 1)
        assert 1 - (1 - jaccard.PASSAGE ** (rows - 1)) ** fewer > jaccard.CHANCE


def test_measured_recall_of_planted_pairs(spark):
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(0, 1200, 2):
        words = [f"w{rng.randrange(50_000)}" for _ in range(120)]
        other = list(words)
        for at in rng.sample(range(0, 120, 8), 2):
            other[at] = "changed"
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
        if similar(grams(rows[-1][1]), grams(rows[-2][1])) >= 0.8:
            pairs.append(k)
    got = {d: c for d, c, _, _ in links(spark, rows)}
    assert len(pairs) > 500 and sum(got[k + 1] == k for k in pairs) / len(pairs) > 0.99


def test_clashing_columns_keep_their_values(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (None, "c")], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("id", "v", "class_id", "n_grams", "copies")})
    kept = jaccard.keep_one(df).collect()
    assert sorted(r.text for r in kept) == ["a b", "c"] and all(r.id == r.v == r.class_id == r.n_grams == r.copies == 7 for r in kept)


def test_keep_one(spark):
    rows = corpus(3) + [(None, "without any id"), (None, "another without"), (907, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit("extra"))
    kept = jaccard.keep_one(df)
    assert kept.columns == ["doc_id", "text", "v"]
    back = kept.collect()
    assert sorted(r.text for r in back if r.doc_id is None) == ["another without", "without any id"]
    assert sorted(r.doc_id for r in back if r.doc_id is not None) == sorted({c for _, c, _, _ in brute(rows) if c is not None})
    assert jaccard.keep_one(df.limit(0)).collect() == []


def test_bands_reach_the_recall():
    for rows in (4, 8):
        b = jaccard.bands_for(0.8, 0.999, rows)
        assert (1 - 0.8**rows) ** b <= 0.001 < (1 - 0.8**rows) ** (b - 1)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert len(got) == 41 + 30
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    with pytest.raises(ValueError):
        jaccard.components(spark.createDataFrame(edges, "a long, b long"), levels=1)
