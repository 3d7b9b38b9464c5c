"""Golden cases and properties of the engine proper."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import cleaning, jsonx, keywords, rewards, spans
from glyphmill.functions.schema import KEYWORD_SCHEMA, ExtractionTask, FieldSpec, Kind, SchemaRegistry, TaskSchema
from glyphmill.operators import datasets, extraction, fallback, keyword_rows
from glyphmill.operators.clients import canned, canned_pairs, joined_chunks, retrying
from glyphmill.sources import readers
from glyphmill.streaming import facade


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("c")).first()["c"]


@pytest.mark.parametrize(("text", "word", "ok"), [("已经退货", "没退货", False), ("衣服不怎么粘肉", "不粘肉", True), ("聊个不停说了一整天", "聊天", False)])
def test_span_examples(spark, text, word, ok):
    assert one(spark, F.expr(f"coalesce({keywords.span_valid('w', 't')}, false)"), t=text, w=word) is ok


def test_span_forms_agree(spark):
    random.seed(5)
    cases = [("".join(random.choices("abc ", k=random.randint(0, 30))), "".join(random.choices("abc", k=random.randint(1, 4)))) for _ in range(200)]
    df = spark.createDataFrame(cases, "t string, w string")
    out = df.select("t", "w", F.expr(keywords.min_span("w", "t")).alias("a"), spans.min_span_udf("w", "t").alias("b")).collect()
    assert all(r["a"] == r["b"] == spans.least_span(r["w"], r["t"]) for r in out)


def test_answer_to_keywords(spark):
    raw = '好的 {"keywords": [["评价","宝贝","0.95"],["x","态度",0.9],["x","回复",0.8],["x","宝贝",0.7],["x","东西",0.99],["x","购物",0.6],["x","清楚地看到很远",0.99],["x","昨天",0.9]]}'
    df = spark.createDataFrame([(raw, "")], "raw string, text string").withColumn("k", keywords.normalize(jsonx.keyword_items(jsonx.greedy_object(F.col("raw")))))
    done = df.select(keywords.words_only(keywords.post_process("k", "text", stopwords=keywords.STOPWORDS)).alias("w")).first()["w"]
    assert done == ["宝贝", "态度", "回复", "购物"]


def test_list_and_row_forms_agree(spark):
    random.seed(1)
    words = ["aa", "ab", "bc", "cd", "the", "other", "x"]
    lists = [(i, [("", random.choice(words), random.choice([0.1, 0.5, 0.9]), p) for p in range(random.randint(0, 12))]) for i in range(60)]
    df = spark.createDataFrame(lists, f"id int, kws array<{keywords.KEYWORD}>")
    a = df.select("id", keywords.words_only(keywords.top_n(keywords.no_stopwords(keywords.dedupe(keywords.sort_by_score(F.col("kws"))), ["the"]), 3)).alias("w")).collect()
    stop = spark.createDataFrame([("the",)], "word string")
    rows = df.select("id", F.explode("kws").alias("k")).select("id", "k.keyword", "k.score", "k.pos")
    top = keyword_rows.top_n(keyword_rows.stop_exact(keyword_rows.keep_first(rows), stop), 3).orderBy("id", "rank").collect()
    by_id = {}
    for r in top:
        by_id.setdefault(r["id"], []).append(r["keyword"])
    assert {r["id"]: r["w"] for r in a if r["w"]} == by_id
    kept = keyword_rows.stop_contains(rows, spark.createDataFrame([("he",)], "word string")).select("keyword").distinct().collect()
    assert {r["keyword"] for r in kept} == {w for w in words if "he" not in w} & {k[1] for _, ks in lists for k in ks}


def test_scores_that_are_no_numbers(spark):
    texts = ["1.0d", "0.95f", " 0.95 ", "abc", "1e-1", "", None]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(keywords.to_score(F.col("t")).alias("c")).collect()]
    assert got == [0.5, 0.5, 0.95, 0.5, 0.1, 0.5, 0.5]


def test_html_and_length(spark):
    assert one(spark, cleaning.unescape_html(F.col("t")), t="a &amp;lt; b&hellip;") == "a < b…"
    assert len(one(spark, cleaning.preprocess_inference(F.col("t")), t="x。y" * 400)) == 512
    assert one(spark, cleaning.preprocess_inference(F.col("t")), t=None) == ""


def test_schema(spark):
    inner = TaskSchema("item", [FieldSpec("a", Kind.STRING, max_length=2), FieldSpec("b", Kind.INTEGER, required=False)])
    schema = TaskSchema("t", [FieldSpec("xs", Kind.ARRAY_OF_OBJECTS, item_schema=inner), FieldSpec("n", Kind.FLOAT, required=False)], root_key="root")
    errors = lambda d: one(spark, F.array_join(schema.errors(F.try_parse_json("t")), "; "), t=json.dumps(d))
    assert errors({"xs": [{"a": "ok"}], "n": True, "more": 1}) == ""
    assert errors({}) == "Field 'xs' is required"
    assert errors({"xs": [{"a": "long"}], "n": "1"}) == """Field 'xs[0]': ["Field 'a' length must not exceed 2"]; Field 'n' should be numeric type"""
    assert errors({"xs": [1]}) == "Field 'xs[0]' should be object type"
    assert schema.json_schema()["properties"]["root"]["properties"]["xs"]["items"]["required"] == ["a"]
    assert schema.required() == ["xs"] and schema.optional() == ["n"] and schema.get_field("n").kind is Kind.FLOAT
    assert schema.struct_type().fieldNames() == ["xs", "n"]
    SchemaRegistry.register("t", schema)
    assert SchemaRegistry.get("t") is schema and "t" in SchemaRegistry.names() and SchemaRegistry.unregister("t") and SchemaRegistry.get("t") is None
    assert ExtractionTask("x", schema).info()["name"] == "x"


def test_reward(spark):
    gold = '{"keywords": [["r", "屏幕", 1]]}'
    answer = "<think>" + "评价" * 30 + "</think>" + gold
    prompt = "【待处理评论】\n屏幕好\n\n请严格"
    c = rewards.PRESETS["keyword"]
    col = lambda name: rewards.reward_parts(F.col("a"), F.col("g"), F.col("p"), c)[name]
    assert one(spark, col("total"), a=answer, g=gold, p=prompt) == pytest.approx(1.0)
    assert one(spark, col("total"), a="<think>x</think> no json", g=gold, p=prompt) == pytest.approx(0.05)
    assert one(spark, col("penalty"), a=gold, g=gold, p="别的") == pytest.approx(0.1)
    assert one(spark, col("total"), a=gold, g=None, p="屏幕") == pytest.approx(0.2 + 0.2 + 0.1 + 0.2)


def test_extraction_with_failing_clients(spark):
    rows = spark.createDataFrame([("1", "电池很好用"), ("2", ""), (None, "screen is bright")], "id string, text string")
    config = extraction.Config(filter_not_in_original=False, max_keyword_length=40)
    good = {r["id"]: r for r in extraction.extract(rows, KEYWORD_SCHEMA, canned, config).collect()}
    assert good["2"]["error"] == "Text is empty after preprocessing" and good["1"]["error"] is None and not good["1"]["is_fallback"]

    def broken():
        def client(system, user, params):
            raise RuntimeError("extra_body not supported" if "extra_body" in params else "down")

        return client

    bad = {r["id"]: r for r in extraction.extract(rows, KEYWORD_SCHEMA, broken, config).collect()}
    assert bad["unknown"]["is_fallback"] and bad["unknown"]["attempts"] == 4 and "bright" in bad["unknown"]["keywords"]
    none = {r["id"]: r for r in extraction.extract(rows, KEYWORD_SCHEMA, broken, extraction.Config(enable_fallback=False)).collect()}
    assert none["1"]["error"] == "Extraction failed"


def test_calls():
    seen = []

    def client(system, user, params):
        seen.append(params)
        if "extra_body" in params:
            raise ValueError("unknown extra_body")
        return " ok "

    assert extraction.call(client, "s", "u", extraction.request_params(extraction.Config(), 2)) == "ok" and len(seen) == 2
    assert extraction.request_params(extraction.Config(), 1).get("frequency_penalty") is None
    assert extraction.Config.from_dict({"seed": 7, "no_such": 1}).seed == 7


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,Comment,text\n1,"good, very",x\n2,NA,y\n3,,z\n', encoding="utf-8")
    assert [r["comment"] for r in readers.read_comments(spark, str(tmp_path / "a.csv")).collect()] == ["good, very"]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n bad \n {"a": 2} \n', encoding="utf-8")
    assert readers.read_json_lines(spark, str(tmp_path / "a.jsonl")).count() == 2
    readers.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"a":1,"b":null}'
    assert readers.comment_column(spark.createDataFrame([(1,)], "x int")).count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "1", "describe": "", "text": "电池很好用", "raw": '{"keywords": [["r", "电池", 0.9], ["r", "好用", "0.95"]]}'}) + "\n", encoding="utf-8")
    out = facade.keyword_stream(facade.read_items(spark, str(tmp_path / "in")))
    facade.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["keywords"] == ["好用", "电池"]


def test_chinese_tokens(spark):
    text = "这套快速衣穿着非常好，一点不显胖 Nice衣 x"
    words = one(spark, fallback.word_tokens(F.col("t")), t=text)
    assert words == ["这套", "套快", "快速", "速衣", "衣穿", "穿着", "着非", "非常", "常好", "一点", "点不", "不显", "显胖", "nice", "衣", "x"]
    rows = spark.createDataFrame([(1, text), (2, "衣服很好"), (2, None)], "id long, text string")
    for method in ("tfidf", "textrank", "simple", None, "other"):
        found = fallback.extract(rows, method, 5).collect()
        assert {r["id"] for r in found} == {1, 2} and all(0 < r["score"] <= 1 and len(r["keyword"]) >= 2 for r in found), method


def test_tfidf_forms_agree(spark):
    random.seed(2)
    texts = [(k, " ".join(random.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], k=random.randint(0, 30)))) for k in range(50)]
    df = spark.createDataFrame(texts, "id long, text string")
    a, b = ({tuple(r) for r in fallback.tfidf(df, 3, sent=n).collect()} for n in (100, 0))
    assert a == b and len(a) > 100


def test_tfidf_bounds_are_exact(spark):
    """Whatever number of frequencies is told, the best words are those of brute force: rare words, ties, copies, nulls, empty texts, ids that repeat."""
    rng = random.Random(5)
    names = ["w" + "".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(400)]
    texts = [" ".join(names[min(int(rng.paretovariate(0.7)), 399)] for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [texts[0]] * 60 + [None, "", "a b", " ".join(names)]
    rows = [(k % 200, t) for k, t in enumerate(texts)]
    tallies = [Counter(w for w in (t or "").split() if len(w) >= 3) for t in texts]
    spread = Counter(w for tally in tallies for w in tally)
    want = []
    for (i, _), tally in zip(rows, tallies, strict=True):
        weights = sorted((-round(c / tally.total() * (math.log((len(rows) + 1) / (spread[w] + 1)) + 1), 6), w) for w, c in tally.items())
        want += [(i, w, min(-2 * m, 1.0), r + 1) for r, (m, w) in enumerate(weights[:5])]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    least = []
    for sent in (10_000, 200, 30, 2, 0):
        got = [tuple(r) for r in fallback.tfidf(df, 5, sent=sent).collect()]
        least.append(fallback._well_known(spark.createDataFrame(list(spread.items()), "keyword string, df long"), sent))
        assert Counter((i, r) for i, _, _, r in got) == Counter((i, r) for i, _, _, r in want), sent
        assert sorted((i, w, round(s, 5)) for i, w, s, _ in got) == sorted((i, w, round(s, 5)) for i, w, s, _ in want), sent
        assert sum(c >= least[-1] for c in spread.values()) <= sent
    assert least == sorted(least) and least[0] == 1 and least[-1] == 1 + max(spread.values())
    assert fallback.tfidf(df.limit(0), 5).count() == fallback.tfidf(df.where("text is null"), 5, sent=0).count() == 0


def test_extraction_tells_rows_apart(spark):
    """Items without an id, and items that share one, keep their own keywords; the fallback's data are triples."""
    rows = spark.createDataFrame([(None, "alpha screen"), (None, "bright battery"), ("7", "green apple"), ("7", "yellow melon")], "id string, text string")
    out = extraction.extract(rows, KEYWORD_SCHEMA, lambda: lambda s, u, p: None, extraction.Config(enable_preprocess=False)).collect()
    assert sorted((r["id"], sorted(r["keywords"])) for r in out) == [("7", ["apple", "green"]), ("7", ["melon", "yellow"]), ("unknown", ["alpha", "screen"]), ("unknown", ["battery", "bright"])]
    data = json.loads(out[0]["data"])["keywords"]
    assert all(len(x) == 3 and x[0] == "fallback-tfidf" and 0 < x[2] <= 1 for x in data) and [x[1] for x in data] == out[0]["keywords"]


def test_generated_records(spark):
    rows = spark.createDataFrame([(0, "屏幕很好用"), (1, "english only"), (2, None), (3, "物流快。silence")], "index long, comment string")

    def deaf():
        return lambda system, user, params: None

    got = {r["index"]: r["record"] for r in datasets.generated(rows, canned_pairs).collect()}
    assert set(got) == {0, 3} and got[0]["preprocessed_comment"] == "屏幕很好用" and json.loads(got[0]["parsed_result"]["chosen_json"])["keywords"]
    none = {r["index"]: r["record"] for r in datasets.generated(rows, deaf).collect()}
    assert none[0]["raw_response"] is None and none[0]["parsed_result"] is None
    sft = {r["index"]: r["record"] for r in datasets.generated(rows, canned, kind="sft").collect()}
    assert json.loads(sft[0]["keywords"])[0][2] == 0.9 and set(sft[0].asDict()) == {"index", "original_comment", "preprocessed_comment", "raw_response", "keywords"}


def test_index(spark):
    random.seed(3)
    rows = [(k, random.choice(["a", "a", "a", 'b "c"', None]), f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "k long, s string, t string").repartition(5)
    index = {r["k"]: r["index"] for r in datasets.indexed(df, "k", "s").collect()}
    for s in {r[1] for r in rows}:
        own = [r[0] for r in rows if r[1] == s]
        assert [index[k] for k in own] == list(range(len(own)))
    assert sorted(r["index"] for r in datasets.indexed(df, "k").collect()) == list(range(300))


def test_streamed_answers_and_patience():
    lines = [b'data: {"choices": [{"delta": {"role": "assistant"}}]}', b"", b'data: {"choices": [{"delta": {"content": "a\xc3\xa9"}}]}', 'data: {"choices": [{"delta": {"content": "b"}}]}', b"data: [DONE]", b"data: bad"]
    assert joined_chunks(lines) == "aéb"
    calls = []

    def client(system, user, params):
        calls.append(user)
        if len(calls) < 3:
            raise OSError("busy")
        return "fine"

    assert retrying(client, attempts=5, pause=0)("s", "u", {}) == "fine" and len(calls) == 3
    calls.clear()
    assert retrying(client, attempts=2, pause=0)("s", "u", {}) is None


def test_schema_details(spark, tmp_path):
    inner = TaskSchema("item", [FieldSpec("a", Kind.STRING)])
    spec = FieldSpec("xs", Kind.ARRAY, item_schema=inner, examples=[["x"]])
    assert spec.json_schema()["items"] == inner.json_schema() and spec.json_schema()["examples"] == [["x"]]
    SchemaRegistry.register("inner", inner)
    assert extraction.Config.from_dict({"schema_name": "inner"}).task_schema() is inner and extraction.Config().task_schema() is None
    SchemaRegistry.unregister("inner")


def test_reward_hooks(spark):
    assert {"keyword", "sentiment", "entity"} <= set(rewards.names())
    entities = rewards.create("entity", words=lambda obj: F.from_json(F.get_json_object(obj, "$.entities[*].text"), "array<string>"), validators={"any": len})
    answer = '{"entities": [{"text": "巴黎"}, {"text": "伦敦"}]}'
    assert one(spark, entities.parts(F.col("a"), F.col("a"), F.col("a"))["f1"], a=answer) == pytest.approx(1.0)
    assert rewards.create("nothing").config == rewards.RewardConfig() and entities.validators["any"] is len
    assert one(spark, F.array_join(rewards.parse_solution(F.col("a")), "|"), a='so {"keywords": [["r", " 好 ", 1], "x", 3]} end') == "好|x"
    assert one(spark, F.size(rewards.parse_solution(F.col("a"))), a="none") == 0
