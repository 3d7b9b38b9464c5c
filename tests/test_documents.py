"""One JSON document a category: whole, in order, also after attempts that failed."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import datasets
from glyphmill.sources import documents


def record():
    return datasets.sft_record(F.col("k"), F.col("t"), F.col("t"), F.lit(None).cast("string"), F.col("t"))


def test_each_category_is_one_document(spark, tmp_path):
    random.seed(3)
    texts = ["plain", 'quote " and \\', "line\nbreak", "ideographs 好", "", None, "],", "]}"]
    rows = [(k, random.choice(["a", "a", "a", 'b "c"/d', "..", "é 好", None, "null", "%null"]), random.choice(texts)) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, s string, t string").repartition(5)
    path = str(tmp_path / "out folder")
    done = {r["category"]: (r["file"], r["n"]) for r in documents.write_documents(datasets.indexed(df, "k", "s"), path, category="s", index="index", record=record(), suffix="_sft_results.json").collect()}
    categories = {r[1] for r in rows}
    assert set(done) == categories and documents.listed(path) == sorted(f for f, _ in done.values()) and len(documents.listed(path)) == len(categories)
    assert [p.name for p in (tmp_path / "out folder").iterdir() if p.name.startswith(".")] == []
    for category, (file, n) in done.items():
        made = json.loads(open(file, encoding="utf-8").read())
        own = [r for r in rows if r[1] == category]
        assert made["category"] == category and made["total_count"] == n == len(own)
        assert [(x["index"], x["original_comment"]) for x in made["results"]] == [(r[0], r[2]) for r in own] and made["results"][0]["raw_response"] is None
    back = documents.read_documents(spark, path).collect()
    assert sorted((str(r["category"]), r["count"], r["at"], json.loads(r["record"])["index"]) for r in back) == sorted((str(c), done[c][1], i, r[0]) for c in categories for i, r in enumerate(x for x in rows if x[1] == c))
    # written again, documents are replaced
    documents.write_documents(df.where("s = 'a' and k < 50"), path, category="s", index="k", record=record(), suffix="_sft_results.json")
    assert json.loads(open(done["a"][0], encoding="utf-8").read())["total_count"] < done["a"][1] and len(documents.listed(path)) == len(categories)


def batches(rows):
    return iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 3], strict=True)], ["category", "at", "line"]) for k in range(0, len(rows), 3)])


def test_retried_tasks_leave_no_trace(tmp_path):
    """An attempt that failed half way and one that lost the race are in no message, so their parts are in no document."""
    folder = str(tmp_path / "staging")
    writer = documents.PartWriter(folder)
    rows = [("a", k, json.dumps({"index": k})) for k in range(8)] + [("b", k, json.dumps({"index": k})) for k in range(4)]

    def failing():
        yield from batches(rows[:6])
        raise OSError("lost executor")

    with pytest.raises(OSError, match="lost"):
        writer.write(failing())
    lost, first, second = writer.write(batches(rows[:7])), writer.write(batches(rows[:7])), writer.write(batches(rows[7:]))
    assert lost.parts != first.parts and len(list((tmp_path / "staging").iterdir())) == 5
    writer.commit([second, None, first])
    parts = [json.loads(x) for x in (tmp_path / "staging" / "manifest").read_text().splitlines()]
    for category, n in (("a", 8), ("b", 4)):
        own = [tuple(p[1:]) for p in parts if p[0] == category]
        for _ in range(2):  # the joining task is tried again too
            file, count = documents.joined(str(tmp_path), category, own, "total_count", ".json")
        made = json.loads(open(file, encoding="utf-8").read())
        assert count == n and [r["index"] for r in made["results"]] == list(range(n))
    writer.abort([first, None])
    assert not any(p[3] in {str(x) for x in (tmp_path / "staging").iterdir()} for p in first.parts)


def test_no_rows_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    assert documents.write_documents(spark.createDataFrame([], "k long, s string, t string"), path, category="s", index="k", record=record()).count() == 0
    assert documents.listed(path) == []
