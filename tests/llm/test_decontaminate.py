import hashlib
import random
import re

import duckdb

from lavra.llm import catalog, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items):
    """The agreed columns, window by window and place by place."""
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            x = words(item)
            n = min(len(x), 10)
            if not n:
                continue
            for s in range(len(x) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def tables():
    rng = random.Random(11)
    vocabulary = ["the", "of", "a", "École", "école", "x1", "naïve", "one", "two", "three", "日本"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 9, 10, 11, 14, 30]))) for k in range(12)] + [(20, "the the the the the the the the the the the"), (21, "rare1 rare2"), (22, "never seen words"), (23, None), (24, ""), (25, "?!")]
    items += [(30, items[4][1]), (31, items[4][1].upper()), (101, items[5][1])]
    docs = [(k, say(rng.randrange(0, 120))) for k in range(120)]
    for k in range(120, 240):
        text = [say(rng.randrange(0, 30))]
        for _ in range(rng.randrange(1, 4)):
            w = (rng.choice(items)[1] or "").split()
            lo = rng.randrange(0, max(1, len(w) - 9))
            text += [rng.choice([", ", " - ", "\n"]).join(w[lo : lo + rng.randrange(8, 40)]), say(rng.randrange(0, 5))]
        docs.append((k, " ".join(text).title() if k % 7 == 0 else " ".join(text)))
    docs += [(300, None), (301, ""), (302, "..."), (303, "The " * 400), (None, items[6][1]), (5, items[6][1]), (5, items[6][1]), (304, "_".join(items[6][1].split())), (305, "\x00rare1\x00rare2\x00"), (306, "rare1 rare3 rare2")]
    return docs, items


def test_query_and_twin_equal_plain_rows(spark, tmp_path):
    docs, items = tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as term", "3 as pos", "'x' as words")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as phrase", "2 as n").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.op13_decontaminate(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda r: (r[0] is None, r)
    want = sorted(plain(docs, items), key=key)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert sorted(map(tuple, got.collect()), key=key) == want
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    twin = db.execute(catalog.ORACLE_SQL["op13_decontaminate"]).fetchall()
    # DuckDB's strings hold what the pattern takes as separators, the null character included.
    assert sorted(twin, key=key) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = decontaminate.contamination(decontaminate.build_index(docs, items.limit(0)))
    assert sorted(tuple(r) for r in none.collect()) == [(1, 2, 0, 0, [], False), (2, 0, 0, 0, [], False)]
    assert decontaminate.contamination(decontaminate.build_index(docs.limit(0), items)).collect() == []


def plain_near(docs, items, size, reach):
    from collections import Counter

    known = {x for _, i in items for x in words(i)}
    places = [[(p, w) for p, w in enumerate(words(t))] for _, t in docs]
    count = Counter(w for ps in places for _, w in ps if w in known)
    found = set()
    for (doc_id, _), ps in zip(docs, places):
        for item_id, item in items:
            x = words(item)
            n = min(len(x), size)
            for s in range(len(x) - n + 1 if n else 0):
                window = x[s : s + n]
                rare = min(window, key=lambda w: (count[w], window.index(w)))
                if any(w == rare and all(any(v == y and abs(p - q) <= reach for q, v in ps) for y in window) for p, w in ps):
                    found.add((doc_id, str(item_id)))
    return found


def test_near_matches_equal_trying_all(spark):
    docs, items = tables()
    docs = [(k, t) for k, (_, t) in enumerate(docs)] + [(900, "rare2 and then rare1"), (901, "rare1 " + "the " * 30 + "rare2")]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    for size, reach in ((10, 20), (4, 3)):
        got = decontaminate.near_matches(index, size, reach).join(index.members, "phrase").join(index.texts, "row").select("id", "item").distinct()
        assert {tuple(r) for r in got.collect()} == plain_near(docs, items, size, reach)


def test_drop_contaminated_keeps_the_rest_as_it_is(spark):
    docs, items = tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id as key", "text", "1 as bad", "2 as id")
    kept = decontaminate.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), "key")
    want = [(i, t, 1, 2) for (i, t), r in zip(docs, plain(docs, items)) if not r[5]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)


def test_no_python_on_the_way(spark):
    docs, items = tables()
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = decontaminate.contamination(index)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
