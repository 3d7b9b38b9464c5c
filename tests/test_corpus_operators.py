"""Segmentation by brute force over all paths, reports against exact values, typed data, JSON as Python reads it, lists of rewards."""

import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import jsonx, rewards
from glyphmill.functions.schema import FieldSpec, Kind, TaskSchema
from glyphmill.operators import datasets, extraction, fallback, report, segment
from glyphmill.sources import readers


def paths(run):
    """All ways to cut a run."""
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(run)]
        yield [run[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_best_path_by_brute_force():
    random.seed(1)
    for _ in range(60):
        letters = "一二三四"
        words = {"".join(random.choices(letters, k=random.randint(1, 4))): random.randint(1, 50) for _ in range(random.randint(1, 12))}
        lattice = segment.Lattice(words.items())
        total = math.log(sum(words.values()))
        weight = lambda w: math.log(words[w]) - total if w in words else lattice.unknown if len(w) == 1 else -math.inf
        run = "".join(random.choices(letters + "五", k=random.randint(1, 9)))
        best = max(sum(map(weight, p)) for p in paths(run))
        found = lattice.path(run)
        assert "".join(found) == run and sum(map(weight, found)) == pytest.approx(best)
    assert segment.Lattice([]).path("好的") == ["好", "的"]


def test_lexicon_and_segmenter(spark):
    """Words that come again among changing neighbours are found; runs of letters and classes are kept apart."""
    random.seed(2)
    words = ["电池", "屏幕", "质量", "物流包"]
    texts = ["".join(random.choice(words) + random.choice("的了很好也不太就") for _ in range(random.randint(3, 8))) + " Nice ok" for _ in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "only letters")], "id long, text string").repartition(3)
    found = {r["word"]: r for r in segment.lexicon(docs).collect()}
    assert set(words) <= set(found) and found["电池"]["n"] == sum(t.count("电池") for t in texts) and "池的" not in found and "流包" not in found
    assert found["电池"]["cohesion"] >= 1 and found["电池"]["entropy"] > 1
    tokens = {r["id"]: r["w"] for r in docs.select("id", segment.segmenter(segment.lexicon(docs, cohesion=2.0))(F.col("text")).alias("w")).collect()}
    for k, t in enumerate(texts):
        assert "".join(tokens[k]) == t.lower().replace(" ", "") and Counter(w for w in tokens[k] if w in words) == Counter({w: t.count(w) for w in words if w in t})
    assert tokens[900] == tokens[901] == [] and tokens[902] == ["only", "letters"]
    classed = spark.createDataFrame([("电池", 9, "n"), ("屏幕", 9, "n"), ("很", 9, "d"), ("质量", 9, None)], "word string, n long, class string")
    nouns = docs.select("id", segment.segmenter(classed, classes=["n"])(F.col("text")).alias("w")).collect()
    assert all(r["w"] == [w for w in tokens[r["id"]] if w in ("电池", "屏幕")] for r in nouns)
    top = fallback.tfidf(docs, 3, tokenizer=segment.segmenter(segment.lexicon(docs, cohesion=2.0)), least=2).collect()
    assert {r["keyword"] for r in top} <= set(words) | {"nice", "ok", "only", "letters"} and {r["id"] for r in top} >= set(range(200))
    assert segment.lexicon(docs.where("id > 899")).count() == 0


def test_report(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b", None]), random.choice(["x"] * 8 + ["y", None]), random.randint(0, 10**6) if random.random() < 0.97 else None, f"t{random.randint(0, 3000)}") for _ in range(20_000)]
    df = spark.createDataFrame(rows, "lang string, source string, n long, t string").repartition(5)
    make = lambda d: report.quality_report(d, ["lang", "source"], flags={"big": F.col("n") > 900_000}, measures={"n": F.col("n")}, distinct={"t": F.col("t")})
    whole = report.read_off(make(df), [0.1, 0.5, 0.99]).collect()
    halves = report.merged([make(df.where("n % 2 = 0 or n is null")), make(df.where("n % 2 = 1"))], ["lang", "source"])
    both = {(r["level"], r["lang"], r["source"]): r for r in report.read_off(halves, [0.1, 0.5, 0.99]).collect()}
    assert len(whole) == len(both) == 9 + 3 + 3 + 1
    for r in whole:
        own = [x for x in rows if (r["level"] & 2 or x[0] == r["lang"]) and (r["level"] & 1 or x[1] == r["source"])]
        n = sorted(x[2] for x in own if x[2] is not None)
        for got in (r, both[r["level"], r["lang"], r["source"]]):
            assert (got["rows"], got["n_big"], got["values_n"], got["sum_n"], got["least_n"], got["most_n"]) == (len(own), sum(x > 900_000 for x in n), len(n), sum(n), n[0], n[-1])
            for q, value in zip((0.1, 0.5, 0.99), got["q_n"], strict=True):
                assert abs(sum(x <= value for x in n) / len(n) - q) < 0.02
            assert got["about_t"] == pytest.approx(len({x[3] for x in own}), rel=0.06, abs=1)
    empty = report.read_off(make(df.limit(0)), [0.5]).collect()
    assert all(r["rows"] == 0 and r["q_n"] is None for r in empty)


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("c")).first()["c"]


def test_plain_json(spark):
    cases = {
        '{"a": 1, "a": 2}': {"a": 2}, '{"a": {"b": 1, "b": [1, NaN]}}': {"a": {"b": [1, "NaN"]}}, '{"a": -Infinity, "b": 1e999}': {"a": "-Infinity", "b": "1e999"},
        '{"a": 1': None, "no": None, "": None, '{"a": "好\\n", "a": "\\ud800"}': {"a": "?"}, "[" * 100_000: None,
    }
    for text, want in cases.items():
        got = one(spark, jsonx.mended(F.col("t")), t=text)
        assert (got and json.loads(got)) == want, text[:40]
    same = ' { "b" : 1.50 } '
    assert one(spark, jsonx.mended(F.col("t")), t=same) == same and one(spark, jsonx.mended(F.col("t")), t=None) is None
    assert jsonx.plain_answer('x {"k": 1, "k": NaN} y') == 'x {"k": "NaN"} y' and jsonx.plain_answer("none") == "none" and jsonx.plain_answer(None) is None
    lines = spark.createDataFrame([('{"a": 1}',), (' {"a": 1, "a": NaN}',), ("bad",), ("",)], "value string")
    assert sorted(r["value"] for r in readers.json_lines(lines, lenient=True).collect()) == ['{"a": "NaN"}', '{"a": 1}'] and readers.json_lines(lines).count() == 1


SCHEMA = TaskSchema(
    "t",
    [FieldSpec("s", Kind.STRING), FieldSpec("i", Kind.INTEGER), FieldSpec("f", Kind.FLOAT), FieldSpec("b", Kind.BOOLEAN), FieldSpec("xs", Kind.ARRAY, item_kind=Kind.INTEGER), FieldSpec("o", Kind.OBJECT),
     FieldSpec("rows", Kind.ARRAY_OF_OBJECTS, item_schema=TaskSchema("r", [FieldSpec("k", Kind.STRING), FieldSpec("n", Kind.FLOAT)]))],
)


def test_typed(spark):
    data = [
        ({"s": "x", "i": 3, "f": 1, "b": True, "xs": [1, 2], "o": {"q": 1}, "rows": [{"k": "a", "n": 0.5}], "more": 1}, ("x", 3, 1.0, True, [1, 2], [("a", 0.5)]), []),
        ({"s": 1, "i": "3", "f": True, "b": "true", "xs": [1, "2"], "o": [], "rows": [{"k": 1, "n": 2}, 3]}, (None, None, 1.0, None, [1, None], [(None, 2.0), None]), ["s", "i", "b", "xs", "o", "rows"]),
        ({"s": None, "i": True}, (None, 1, None, None, None, None), []),
        ({}, (None,) * 6, []),
    ]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _, _) in enumerate(data)], "k int, j string").withColumn("v", F.try_parse_json("j"))
    made = df.select("k", SCHEMA.typed(F.col("v")).alias("r"), SCHEMA.misfits(F.col("v")).alias("m"))
    assert [f.dataType.simpleString() for f in made.schema["r"].dataType.fields] == ["string", "bigint", "double", "boolean", "array<bigint>", "variant", "array<struct<k:string,n:double>>"]
    for r, (_, want, misfits) in zip(made.orderBy("k").collect(), data, strict=True):
        got = r["r"]
        rows = got["rows"] and [x and tuple(x) for x in got["rows"]]
        assert (got["s"], got["i"], got["f"], got["b"], got["xs"], rows) == want and r["m"] == misfits


def test_typed_extraction(spark, tmp_path):
    """Typed data is a column of the declared struct, of which a reader takes the fields it asks for; the others' rows are routed by their misfits. Answers with repeated keys are kept."""
    schema = TaskSchema("s", [FieldSpec("sentiment", Kind.STRING), FieldSpec("confidence", Kind.FLOAT)])
    answers = {"good": '{"sentiment": "positive", "confidence": 0.5, "confidence": 0.9}', "odd": '{"sentiment": "negative", "confidence": "high"}', "bad": "none"}

    def factory():
        return lambda system, user, params: next(a for w, a in answers.items() if w in user)

    rows = spark.createDataFrame([(w, f"{w} text here") for w in answers] + [("empty", "")], "id string, text string")
    config = extraction.Config(enable_preprocess=False, enable_post_process=False, enable_fallback=False)
    found = extraction.extract(rows, schema, factory, config, typed=True)
    got = {r["id"]: r for r in found.collect()}
    assert got["good"]["record"].asDict() == {"sentiment": "positive", "confidence": 0.9} and got["good"]["misfits"] == []
    assert got["odd"]["record"].asDict() == {"sentiment": "negative", "confidence": None} and got["odd"]["misfits"] == ["confidence"]
    assert got["bad"]["record"] is None and got["bad"]["error"] == "Extraction failed" and got["empty"]["misfits"] is None
    found.where("size(misfits) = 0").write.parquet(str(tmp_path / "typed"))
    plan = spark.read.parquet(str(tmp_path / "typed")).select("record.confidence")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<record:struct<confidence:double>>" in plan
    assert "record" not in extraction.extract(rows, schema, factory, config).columns


def test_reward_lists(spark):
    gold, think = '{"keywords": [["r", "屏幕", 1]]}', "<think>x</think> no json"
    rows = [(0, [gold, think, gold], [gold, gold], [None, "屏幕", "x"]), (1, [gold, think], [], None), (2, [], [gold], ["p"]), (3, [gold], [None], ["好"]), (4, [gold, gold], [gold, gold], ["屏幕"])]
    df = spark.createDataFrame(rows, "k int, c array<string>, s array<string>, p array<string>")
    single = lambda c, s, p: one(spark, rewards.reward_parts(F.col("c"), F.col("s"), F.col("p"))["total"], c=c, s=s, p=p)
    got = {r["k"]: r["r"] for r in df.where("p is not null").select("k", rewards.reward_list(F.col("c"), F.col("s"), F.col("p")).alias("r")).collect()}
    want = {0: [single(gold, gold, None), single(think, gold, "屏幕")], 2: [], 3: [single(gold, None, "好")], 4: [single(gold, gold, "屏幕")]}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    alone = {r["k"]: r["r"] for r in df.select("k", rewards.reward_list(F.col("c")).alias("r")).collect()}
    assert alone[1] == pytest.approx([single(gold, None, None), single(think, None, None)]) and len(alone[0]) == 3 and alone[2] == []


def test_samples_to_grpo(spark):
    samples = [[("system", "a"), ("user", "u1"), ("user", "u2"), ("assistant", "r")], [("assistant", "r")], [], [("user", "only")], [("user", "x"), ("user", None)]]
    lines = [(json.dumps({"messages": [{"role": r, "content": c} for r, c in s]}),) for s in samples] + [("{}",), ('{"messages": 3}',)]
    made = datasets.sample_to_grpo(spark.createDataFrame(lines, "value string"), "value").collect()
    assert [([m["content"] for m in r["messages"]], r["original_response"]) for r in made] == [(["a", "u2"], "r"), (["", "only"], "")]
