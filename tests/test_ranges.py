"""Files read by ranges, against readers that take a file whole."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from lavra.sources import files, ranges


@pytest.fixture
def in_ranges(spark):
    """Sets how many bytes a range has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield size
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def whole_csv(spark, path, columns):
    kinds = ", ".join(f"{c} string" for c in [*columns, files.REJECT])
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": files.REJECT, "enforceSchema": True}
    return sorted(map(repr, spark.read.schema(kinds).options(**options).csv(path).collect()))


def made_csv(seed, n):
    rng = random.Random(seed)
    field = lambda: rng.choice(["", "x", 'a ""q""', "line\nfeed", "\n", ",", 'é,"",\n', 'five" inch', "y" * rng.randrange(30), '""', "cr\r\nlf"])
    rows = []
    for _ in range(n):
        f = [field() for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))]
        # Whatever needs quotes has them; a quote inside a bare field stays a letter.
        rows.append(",".join(f'"{x}"' if set(x) & set(',\n\r') or x.startswith('"') or '""' in x else x for x in f))
    return "﻿a,b,c\n" + "\n".join(r for r in rows if r)


@pytest.mark.parametrize("ending", ["\n", ""])
def test_csv_equals_the_whole_reader_wherever_it_is_cut(spark, tmp_path, in_ranges, ending):
    text = made_csv(7, 400) + ending
    for pad in (0, 1, 2, 3, 5, 7):
        path = tmp_path / f"t{pad}.csv"
        path.write_bytes(text.replace("a,b,c", "a" * (pad + 1) + ",b,c").encode())
        in_ranges(128 << 20)
        want = whole_csv(spark, str(path), ["a", "b", "c"])
        in_ranges(691 + pad)
        assert ranges._pieces(spark, str(path), "\n").rdd.getNumPartitions() > 8
        got = files.read_table_csv(spark, str(path), ["a", "b", "c"])
        assert sorted(map(repr, got.collect())) == want


def test_csv_of_another_encoding_and_records_longer_than_ranges(spark, tmp_path, in_ranges):
    rows = [["1", "ação\n" + "z" * 3000 + "\n,é"], ["2", "ñ"], ["3", 'q"q']]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([["a", "b"], *rows])
    (tmp_path / "t.csv").write_bytes(out.getvalue().encode("cp1252"))
    in_ranges(500)
    got = files.read_table_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], encoding="cp1252").orderBy("a").collect()
    assert [[r.a, r.b] for r in got] == rows
    (tmp_path / "w.csv").write_bytes(out.getvalue().encode("utf-16"))
    in_ranges(1 << 20)
    assert files.read_table_csv(spark, str(tmp_path / "w.csv"), ["a", "b"], encoding="UTF-16").count() == 3
    with pytest.raises(ValueError):
        ranges.records(spark, str(tmp_path / "w.csv"), "\n", ranges.scan_csv(), encoding="utf-16")


def test_json_lists_equal_json_loads_wherever_they_are_cut(spark, tmp_path, in_ranges):
    rng = random.Random(9)

    def value(deep=0):
        kinds = [lambda: rng.choice(['a,b', 'x"],[', "\\", "é", "", "{", "] }", "\\\"", "\n,"]), lambda: rng.randrange(100), lambda: None, lambda: True]
        if deep < 3:
            kinds += [lambda: [value(deep + 1) for _ in range(rng.randrange(4))], lambda: {rng.choice("abcd"): value(deep + 1) for _ in range(rng.randrange(4))}]
        return rng.choice(kinds)()

    lists = {f"l{k}": [value() if rng.random() < 0.3 else {"titulo": f"t{n}", "x": value(1)} for n in range(120)] for k in range(3)} | {"empty": []}
    for name, found in lists.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(found, indent=rng.choice([None, 1]), ensure_ascii=False), encoding="utf-8")
    bad = {"cut": '[{"a": 1}, {"b": 2}', "comma": '[{"a": 1},]', "two": "[1],[2]", "hole": "[1,,2]", "word": "nope", "object": '{"a": "x,y", "b": [1, 2]}', "text": '"a,b"', "number": "5", "after": '[{"a": 1}] x', "other": '[{"a": 1}}'}
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
    in_ranges(700)
    found, errors = files.read_items_json(spark, str(tmp_path / "*.json"))
    stem = lambda r: r.file.rsplit("/", 1)[1][:-5]
    got = {(stem(r), r.pos): json.loads(r.j) for r in found.select("file", "pos", F.to_json("item").alias("j")).collect()}
    assert got == {(name, k): v for name, vs in lists.items() for k, v in enumerate(vs) if isinstance(v, dict)}
    wrong = errors.collect()
    assert {(stem(r), r.pos) for r in wrong if r.pos is not None} == {(name, k) for name, vs in lists.items() for k, v in enumerate(vs) if not isinstance(v, dict)}
    assert {stem(r): r.kind for r in wrong if r.pos is None} == {n: "no JSON" for n in bad} | {"object": "OBJECT", "text": "STRING", "number": "BIGINT"}


def test_crosswalks_of_lists_and_objects(spark, tmp_path, in_ranges):
    ids = [f"{k:014d}" for k in range(300)]
    (tmp_path / "list.json").write_text(json.dumps([f"{x[:2]}.{x[2:]}" for x in ids[:150]] + ["7", 5, None]))
    (tmp_path / "object.json").write_text(json.dumps({f"k,{k}": x for k, x in enumerate(ids[150:])} | {"n": 5}))
    (tmp_path / "broken.json").write_text(json.dumps(["99999999999999"])[:-1])
    in_ranges(600)
    assert {r.tax_id for r in files.read_crosswalk(spark, str(tmp_path / "*.json")).collect()} == set(ids)


def test_files_of_lists_grow_with_events_not_with_pairs_of_user_and_part(spark, tmp_path):
    from lavra.plans import files as plan

    events = spark.range(2 * plan.LIST_IDS).select(F.col("id").alias("event_id"), (F.col("id") % 1500).alias("user_id"), F.lit("view").alias("event_type"), F.lit('{"k": 7}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    path = plan._lists(spark, str(tmp_path))
    lists = [json.loads(r["value"]) for r in spark.read.option("wholetext", True).text(path).collect()]
    assert len(lists) == 2
    assert [sum(isinstance(x, t) for x in [*lists[0], *lists[1]]) for t in (dict, int, str)] == [9000, 1000, 3000]
    assert {r["kind"]: r["n"] for r in plan.item_errors(spark, str(tmp_path)).collect()} == {"BIGINT": 1000, "STRING": 3000}
    assert plan.items_read(spark, str(tmp_path)).count() == 9000
