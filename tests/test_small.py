"""Hooks, files of settings, flags and rule texts."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import keywords, prompts
from glyphmill.functions.schema import ExtractionTask, FieldSpec, Kind, TaskSchema
from glyphmill.operators import extraction


def test_generator_comes_first(spark):
    """A custom generator sees the text and the task, and a template isn't asked."""
    task = ExtractionTask("x", TaskSchema("t", [FieldSpec("a", Kind.STRING)]))
    seen = []

    def generator(text, own):
        seen.append(own)
        return F.concat(F.lit("about "), F.lit(own.name)), F.upper(text)

    template = prompts.PromptTemplate("system", "user {input_text}")
    df = spark.createDataFrame([("good",), (None,)], "t string")
    pair = prompts.PromptBuilder(task, template, generator).build(F.col("t"))
    assert [tuple(r) for r in df.select(pair[0].alias("s"), pair[1].alias("u")).collect()] == [("about x", "GOOD"), ("about x", None)] and seen == [task]
    pair = prompts.PromptBuilder(task, template).build(F.col("t"))
    assert df.select(pair[0].alias("s"), pair[1].alias("u")).first()["u"] == "user good"
    answers = extraction.extract(spark.createDataFrame([("1", "alpha")], "id string, text string"), task.schema, lambda: lambda s, u, p: f'{{"a": "{s}|{u}"}}', extraction.Config(enable_preprocess=False), prompts.PromptBuilder(task, None, generator))
    assert answers.first()["data"] == '{"a": "about x|ALPHA"}'


def test_settings_in_a_file(tmp_path):
    yaml = pytest.importorskip("yaml")
    path = str(tmp_path / "config.yaml")
    config = extraction.Config(seed=7, model_name="名", filter_time=False, thread_workers=3)
    config.save_yaml(path)
    assert extraction.Config.from_yaml(path) == config and yaml.safe_load(open(path, encoding="utf-8"))["model_name"] == "名"
    (tmp_path / "part.yaml").write_text("seed: 9\nnone_of_ours: 1\n", encoding="utf-8")
    assert extraction.Config.from_yaml(str(tmp_path / "part.yaml")) == extraction.Config(seed=9)
    (tmp_path / "empty.yaml").write_text("", encoding="utf-8")
    assert extraction.Config.from_yaml(str(tmp_path / "empty.yaml")) == extraction.Config()


def test_added_fields(spark):
    schema = TaskSchema("t", [FieldSpec("a", Kind.STRING)])
    schema.add_field(FieldSpec("b", Kind.INTEGER, required=False, min_value=3))
    assert schema.get_field("b").min_value == 3 and schema.get_field("c") is None and schema.required() == ["a"] and schema.optional() == ["b"]
    assert schema.json_schema()["properties"]["b"]["minimum"] == 3 and schema.struct_type().fieldNames() == ["a", "b"]
    df = spark.createDataFrame([('{"a": "x", "b": 2}',)], "j string")
    assert df.select(schema.errors(F.try_parse_json("j")).alias("e")).first()["e"] == ["Field 'b' must not be less than 3"]


def test_backfill_changes_nothing(spark):
    """The flag is accepted: there is never a word left that it could fill up with."""
    words = [("", w, s, p) for p, (w, s) in enumerate([("alpha", 0.9), ("beta", 0.8), ("alpha", 0.7), ("昨天", 0.9), ("gamma", 0.1), ("far away word", 0.9)])]
    df = spark.createDataFrame([(words, "alpha beta gamma")], f"kws array<{keywords.KEYWORD}>, text string")
    for n in (1, 2, 8):
        a, b = (df.select(keywords.words_only(keywords.post_process("kws", "text", n=n, backfill=f)).alias("w")).first()["w"] for f in (True, False))
        assert a == b == ["alpha", "beta", "gamma"][:n]


def test_rule_texts():
    """The rules of a schema, written out by hand."""
    schema = TaskSchema("t", [FieldSpec("mood", Kind.STRING, "the mood", enum=["good", "bad"]), FieldSpec("words", Kind.ARRAY, required=False, max_length=5), FieldSpec("n", Kind.INTEGER, min_length=2)])
    text = prompts.rules_text(schema, ["be brief"], ["no names"])
    assert text.split("\n\n")[1:] == [
        f"字段说明:\n- mood: the mood ({prompts.KIND_LABEL[Kind.STRING]}) [必需] 可选值: ['good', 'bad']\n- words ({prompts.KIND_LABEL[Kind.ARRAY]}) 长度: 0-5\n- n ({prompts.KIND_LABEL[Kind.INTEGER]}) [必需] 长度: 2-∞",
        "特殊规则:\n- be brief", "任务规则:\n- no names",
    ]
    assert prompts.rules_text(TaskSchema("t")) == "\n".join(prompts.BASE_RULES)
