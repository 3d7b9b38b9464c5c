"""Input order over several files and splits, and CSV files with columns of their own in one plan."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import datasets
from glyphmill.sources import ordered


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(tmp_path, sizes):
    random.seed(len(sizes))
    lines = {}
    for k, n in enumerate(sizes):
        own = [f"{k}:{i} " + "x" * random.randint(0, 60) for i in range(n)]
        (tmp_path / f"part {k}é.txt").write_text("".join(x + "\n" for x in own), encoding="utf-8")
        lines[f"part {k}é.txt"] = own
    return lines


def test_lines_know_their_place(spark, tmp_path, small_splits):
    """Every line has its place in its file and in all, whatever the splits."""
    lines = written(tmp_path, [500, 0, 3, 120])
    scan = spark.read.text(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 10
    got = sorted(ordered.read_lines(spark, str(tmp_path)).collect(), key=lambda r: r["position"])
    want = [(name, i, x) for name in sorted(lines) for i, x in enumerate(lines[name])]
    assert [r["position"] for r in got] == list(range(len(want)))
    names = [r[0] for r in spark.createDataFrame([(r["file"],) for r in got], "f string").select(F.regexp_extract(ordered.decoded_path(F.col("f")), "([^/]*)$", 1)).collect()]
    assert [(n, r["line"], r["value"]) for n, r in zip(names, got, strict=True)] == want


@pytest.mark.parametrize("n", [None, 0, 1, 37, 10_000])
def test_first_samples_before_conversion(spark, tmp_path, small_splits, n):
    """The first n good lines in the order of the input; blank and bad ones aren't counted, samples that the conversion drops are."""
    random.seed(6)
    good = []
    for k in range(3):
        with (tmp_path / f"{k}.jsonl").open("w", encoding="utf-8") as f:
            for i in range(150):
                kind = random.randint(0, 4)
                f.write({0: "", 1: "no json {", 2: "   "}.get(kind, json.dumps({"k": k, "i": i, "messages": []})) + "\n")
                if kind > 2:
                    good.append((k, i))
    got = ordered.read_samples(spark, str(tmp_path), n=n).orderBy("position").collect()
    assert [(json.loads(r["value"])["k"], json.loads(r["value"])["i"]) for r in got] == (good[:n] if n else good)
    assert [r["position"] for r in got] == list(range(len(got)))


def categories(tmp_path):
    """Four files: other columns, other orders, quotes over lines, missing values, a name that differs in case, none at all."""
    random.seed(8)
    heads = {"books": ["id", "Comment", "text"], "toys.v2": ["text", "stars"], "food & wine": ["a", "b", "c", "d", "comment"], "none": ["COMMENT", "Text"], "dup": ["text", "Comment", "comment"]}
    want = {}
    for name, head in heads.items():
        col = next((c for c in ("Comment", "comment", "text") if c in head), None)
        with (tmp_path / f"{name}.csv").open("w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(head)
            for i in range(80):
                value = random.choice(["", "NA", "nan", f"{name} {i}", f'quoted "{i}", with\nline', "Comment", "text", "好"])
                out.writerow([value if c == col else f"other {i}" for c in head])
                if col and value not in ("", "NA", "nan"):
                    want.setdefault(name, []).append(value)
    return want


@pytest.mark.parametrize("sent", [100_000, 0])
def test_categories_in_one_plan(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(ordered, "SENT", sent)
    want = categories(tmp_path)
    got = {}
    for r in sorted(ordered.read_category_comments(spark, str(tmp_path)).collect(), key=lambda r: (r["category"], r["index"])):
        got.setdefault(r["category"], []).append((r["index"], r["comment"]))
    assert got == {name: list(enumerate(values)) for name, values in want.items()}
    assert "none" not in got and len(got) == 4
    with pytest.raises(ValueError, match="most_columns"):
        ordered.read_category_comments(spark, str(tmp_path), most_columns=3)


def test_sample_of_each_category(spark, tmp_path):
    want = categories(tmp_path)
    rows = ordered.read_category_comments(spark, str(tmp_path))
    some = datasets.category_sample(rows, {"toys": 5}, 20).collect()
    by = {}
    for r in some:
        by.setdefault(r["category"], []).append((r["index"], r["comment"]))
    assert {k: len(v) for k, v in by.items()} == {"books": 20, "toys.v2": 5, "food & wine": 20, "dup": 20}
    for name, rows in by.items():
        assert sorted(i for i, _ in rows) == list(range(len(rows))) and all(c in want[name] for _, c in rows)
    assert sorted(map(tuple, some)) == sorted(map(tuple, datasets.category_sample(ordered.read_category_comments(spark, str(tmp_path)), {"toys": 5}, 20).collect()))
